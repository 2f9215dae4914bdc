"""One consistent form for text that looks the same but differs in its characters.

The form is computed by DuckDB inside Arrow partitions, in one SQL expression that can be embedded anywhere:
invisible characters go, every blank becomes a space, compatibility forms (full and half width, ligatures, presentation
forms) and look-alike letters are mapped, and ``nfc_normalize`` composes what is left. Case, accents, the number of
blanks and different ASCII characters are kept apart, because a reader sees them.

Defined results: null stays null; an empty text stays empty; a text of invisible characters becomes empty; plain ASCII
comes back as it is, but for tabs and line ends, which become spaces; texts of any length are handled whole.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that print like a Latin letter, and characters that print like one in ASCII.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ӏ": "I", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "Օ": "O", "օ": "o", "Ս": "U", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "ɡ": "g", "ɑ": "a", "ⅼ": "l",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭹ": "y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z",
    "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N",
    "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "‐": "-", "‑": "-", "‒": "-", "﹣": "-", "⁃": "-", "−": "-", "⁄": "/", "∕": "/",
}
#: Kinds of compatibility decomposition that leave the look of a character alone (not super- or subscripts, fractions,
#: circled or squared characters).
_KINDS = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
_INVISIBLE = r"[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]"
_BLANK = r"[\p{Zs}\t\n\v\f\r\x{0085}\x{2028}\x{2029}\x{2800}]"


def _tables() -> tuple[dict[str, str], dict[str, str]]:
    """(one character to one, one to several), built from the Unicode data and the look-alikes."""
    single, several = {}, {}
    for code in [*range(0x80, 0x3400), *range(0xFB00, 0xFE00), *range(0xFE30, 0xFF00), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800)]:
        ch = chr(code)
        kind = unicodedata.decomposition(ch)
        form = unicodedata.normalize("NFKC", ch)
        if not kind.startswith(_KINDS) or form == ch or " " in form or ch in "ſ":
            continue
        form = "".join(LOOKALIKES.get(c, c) for c in form)
        (single if len(form) == 1 else several)[ch] = form
    single |= LOOKALIKES
    for code in [*range(0x370, 0x400), *range(0x400, 0x530), *range(0x1F00, 0x2000)]:  # accented look-alikes
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in LOOKALIKES:
            form = unicodedata.normalize("NFC", LOOKALIKES[parts[0]] + parts[1:])
            (single if len(form) == 1 else several)[chr(code)] = form
    return single, several


_SINGLE, _SEVERAL = _tables()


def form_sql(column: str) -> str:
    """The consistent form of ``column`` as one DuckDB expression."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    bare = f"regexp_replace(regexp_replace({column}, '{_INVISIBLE}', '', 'g'), '{_BLANK}', ' ', 'g')"
    spread = f"translate({bare}, {quoted(''.join(_SINGLE))}, {quoted(''.join(_SINGLE.values()))})"
    # letter by letter only in the few texts that have a form of several characters
    forms = f"MAP([{', '.join(map(quoted, _SEVERAL))}], [{', '.join(map(quoted, _SEVERAL.values()))}])"
    spelled = f"array_to_string(list_transform(string_split(_t, ''), lambda _c: coalesce({forms}[_c], _c)), '')"
    long = f"list_transform([{spread}], lambda _t: CASE WHEN regexp_matches(_t, '[{''.join(_SEVERAL)}]') THEN {spelled} ELSE _t END)[1]"
    return f"CASE WHEN regexp_full_match({column}, '[ -~]*') THEN {column} ELSE nfc_normalize({long}) END"


def with_form(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with a further column: the consistent form of ``column``. A column already called ``out`` is replaced."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.StringType(), True)])
    ident = '"' + column.replace('"', '""') + '"'
    label = '"' + out.replace('"', '""') + '"'
    sql = f"SELECT * EXCLUDE ({label}), {form_sql(ident)} AS {label} FROM _batch" if out in df.columns else f"SELECT *, {form_sql(ident)} AS {label} FROM _batch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches, None)
        if first is None:
            return
        con = duckdb.connect()
        con.execute("SET threads = 1")
        con.register("_batch", pa.RecordBatchReader.from_batches(first.schema, itertools.chain([first], batches)))
        yield from con.sql(sql).to_arrow_reader()

    return df.mapInArrow(run, schema)


def same_looking(obs: DataFrame, files: DataFrame) -> DataFrame:
    """(obs_id, file_id) of an observation and a file whose paths look alike, where the paths or the file's name and
    the observation's last path segment differ in their characters.

    ``obs`` has id and current_path, ``files`` file_id, current_path and filename. Null paths look like nothing. A null
    filename equals no segment, so it differs. Rows are matched as distinct spellings and only differing spellings are
    expanded to rows: a path that a third of all rows share is one spelling.
    """
    seen = with_form(obs.select(F.col("current_path").alias("o_path")).where("o_path is not null").distinct(), "o_path", "form")
    held = with_form(
        files.select(F.col("current_path").alias("f_path"), "filename").where("f_path is not null").distinct(), "f_path", "form"
    )
    differ = (F.col("o_path") != F.col("f_path")) | ~F.col("filename").eqNullSafe(F.element_at(F.split("o_path", "/"), -1))
    spelled = held.join(seen, "form").where(differ).select("o_path", "f_path", F.col("filename").alias("f_name"))
    named = files.select(F.col("current_path").alias("f_path"), F.col("filename").alias("own_name"), "file_id")
    watched = obs.select(F.col("current_path").alias("o_path"), F.col("id").alias("obs_id"))
    return (
        spelled.join(named, (spelled.f_path == named.f_path) & F.col("f_name").eqNullSafe(F.col("own_name")))
        .select("o_path", "file_id")
        .join(watched, "o_path")
        .select("obs_id", "file_id")
        .distinct()
    )
