import base64
import hashlib

from pyspark.sql import functions as F

from shutterloom.llm import history

H = [hashlib.sha256(bytes([i])).hexdigest() for i in range(9)]
KIND = "batch_no int, incoming_id long, size_bytes long, content_hash string, partial_hash string, kind string, digest int"
OLD = "size_bytes long, content_hash string, partial_hash string, first int"


def test_notations(spark):
    same = [H[0], H[0].upper(), f"sha256:{H[0]}", f"SHA256={H[0].upper()}", f"0x{H[0]}", f" {H[0]}\n", ":".join(H[0][i : i + 2] for i in range(0, 64, 2)), "-".join(H[0][i : i + 8] for i in range(0, 64, 8)), base64.b64encode(bytes.fromhex(H[0])).decode(), base64.urlsafe_b64encode(bytes.fromhex(H[0])).decode().rstrip("=")]
    none = [None, "", " ", "-", "n/a", "error", "pending", "0" * 64, "f" * 32, "abc", "deadbeef", "not a hash at all, really", "z" * 44]
    df = spark.createDataFrame([(s,) for s in same + none], "s string")
    got = [r.h for r in df.select(history.digest_hex(F.col("s")).alias("h")).collect()]
    assert got == [H[0]] * len(same) + [None] * len(none)
    tricky = "0xl+E7HhvCzOoufIDjFYbB6J+TTHS27bazNVxT9cOHQ="
    assert spark.createDataFrame([(tricky,)], "s string").select(history.digest_hex(F.col("s"))).first()[0] == base64.b64decode(tricky).hex()


def rows(spark):
    return spark.createDataFrame(
        [
            (1, 1, 5, H[0], None, "c", 0),  # content known from history, shortened there
            (1, 2, 5, H[1], None, "c", 0),  # new
            (2, 1, 9, H[1][:24], None, "c", 0),  # repeats (1, 2) by a shortened digest
            (2, 2, 0, H[1], None, "c", 0),  # no size
            (2, 3, None, H[1], None, "c", 0),
            (2, 4, 7, "pending", H[2], "c", 0),  # partial and size known from history
            (2, 5, 8, None, H[2], "c", 0),  # partial known but of another size
            (3, 1, 8, H[3], H[2], "c", 0),  # repeats (2, 5) though content differs
            (3, 1, 8, H[3], H[2], "c", 0),  # delivered again
            (3, 2, 4, "0" * 64, "-", "c", 0),
            (3, 3, 4, "0" * 64, "-", "c", 0),
            (None, 9, 5, H[0], None, "c", 0),
            (4, None, 5, H[0], None, "c", 0),
            (3, 4, 5, H[4][:16] + "0" * 48, None, "c", 0),
            (3, 5, 5, H[4], None, "c", 0),  # agrees only over the first 64 bits
        ],
        KIND,
    )


def old(spark):
    return spark.createDataFrame([(3, H[0][:40], None, 1), (7, None, f"0x{H[2]}", 1), (0, H[5], None, 1), (None, H[5], None, 1)], OLD)


def test_repeats(spark):
    got = sorted((r.batch_no, r.incoming_id) for r in history.repeats(rows(spark), old(spark)).collect())
    assert got == [(1, 1), (2, 1), (2, 4), (3, 1)]


def test_empty_tables(spark):
    assert history.repeats(rows(spark).limit(0), old(spark)).count() == 0
    got = sorted((r.batch_no, r.incoming_id) for r in history.repeats(rows(spark), old(spark).limit(0)).collect())
    assert got == [(2, 1), (3, 1)]


def test_store_grows_batch_by_batch(spark, tmp_path):
    store = history.PivotStore(spark, str(tmp_path / "table"))
    store.append(old(spark))
    got = sorted(tuple(r) for r in history.accept(rows(spark), store).collect())
    assert got == [(1, 1), (2, 1), (2, 4), (3, 1)]
    assert history.accept(rows(spark).limit(0), store).count() == 0
    held = spark.read.parquet(store.path)
    assert held.count() > held.select("kind", "digest", "size").distinct().count()  # what two batches brought is there twice


def test_only_ranges_in_reach_are_read(spark, tmp_path):
    store = history.PivotStore(spark, str(tmp_path / "table"))
    many = spark.createDataFrame([(5, hashlib.sha256(str(i).encode()).hexdigest(), None, 1) for i in range(400)], OLD)
    store.append(many)
    one = history.with_pivots(history.digest_rows(many.limit(1)))
    got = store.read(one)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "band" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert got.select(F.input_file_name()).distinct().count() == 1 < len(spark.read.parquet(store.path).inputFiles())
    assert history.candidates(one, got, ["kind", "size"]).count() == 1
    assert store.read(one, radius=3 * history.BAND_WIDTH).select(F.input_file_name()).distinct().count() > 1


def test_near_digests_count_within_a_radius(spark):
    at = lambda *w: "".join(f"{x:04x}" for x in w) + "0" * 47 + "1"
    past = spark.createDataFrame([(5, at(100, 200, 300, 400), None, 1)], OLD)
    new = spark.createDataFrame([(1, i, 5, at(100 + d, 200, 300 - d, 400), None, "c", 0) for i, d in enumerate((0, 1, 2, 3))], KIND)
    assert sorted(r.incoming_id for r in history.repeats(new.where("incoming_id in (2, 3)"), past, radius=4).collect()) == [2, 3]
    assert sorted(r.incoming_id for r in history.repeats(new.where("incoming_id = 3"), past, radius=4).collect()) == []
    assert sorted(r.incoming_id for r in history.repeats(new.where("incoming_id < 3"), past).collect()) == [0]


def test_radius_finds_near_points_like_brute_force(spark):
    table = history.with_pivots(spark.createDataFrame([(f"{i:016x}" * 4,) for i in range(0, 4000, 7)], "digest string"))
    probe = history.with_pivots(spark.createDataFrame([(f"{i:016x}" * 4,) for i in range(0, 4000, 501)], "digest string"))
    got = {(int(r.digest[:16], 16), int(r.h_digest[:16], 16)) for r in history.candidates(probe, table, [], radius=9, verify=False).collect()}
    assert got == {(a, b) for a in range(0, 4000, 501) for b in range(0, 4000, 7) if abs(a - b) <= 9}
