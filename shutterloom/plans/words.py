"""Vocabulary of the query planner: our own short lists; all are parameters of the planner.

Fixed values, in natural order.
"""

PERSON = "person people man woman child children baby family friend friends mom dad grandma grandpa 사람 가족 친구 아이 엄마 아빠".split()
TEXT = "text receipt document letter sign menu invoice ticket note written says 글자 영수증 문서 메뉴".split()
SCREEN = "screenshot screen chat 화면 캡처 스크린샷".split()
PLACE = "beach mountain city park lake river museum station market home school airport 바다 산 공원 도시 학교 집".split()
VISUAL = "sunset snow flower cat dog food cake car boat garden night party wedding concert 노을 눈 꽃 고양이 강아지 음식 케이크 자동차".split()
TRAVEL = "trip travel vacation holiday journey 여행 휴가".split()
CELEBRATION = "birthday wedding party anniversary christmas 생일 결혼식 파티".split()
SCENE = "park market home school beach sea river lake forest mountain 바다 산 공원".split()  # too general to force a place filter
LOCATIVE = ("에서", " in ", " at ", " near ")
OR_MARKERS = (" or ", "이나", "또는")
EXCLUDING_EN = ("without", "except", "excluding")
EXCLUDING_KO = ("없이", "없는", "말고", "제외", "빼고")
PLACE_ALIASES = {"서울시": "서울", "seoul": "서울", "부산시": "부산", "busan": "부산", "제주도": "제주", "jeju": "제주"}
LITTLE = "the and with from near for not are was all any old new".split()  # no tag is looked up for these
PHOTO_WORDS = ("photo", "photos", "picture", "pictures", "image", "images", "of", "the", "a", "사진", "이미지")
JOINERS = ("이랑", "하고")
ENDINGS = ("에서는", "이라는", "하는", "했던", "있는")
KEPT = ("여행", "사진", "영상")
TIME_WORDS = "last this next past ago day days week weeks weekend weekday weekdays month months year years today yesterday recently recent newest spring summer autumn fall winter christmas 작년 재작년 올해 지난달 이번달 지난주 이번주 주말 평일 봄 여름 가을 겨울 오늘 어제 그제 그저께 최근 설날 추석 크리스마스 상반기 하반기 연초 연말 월초 월말".split()
ONLY = ("only", "just", "만 나온", "혼자")
TYPOS = {"beech": "beach", "recipt": "receipt", "sunsett": "sunset", "mountian": "mountain", "wediing": "wedding", "familly": "family"}
TRANSLATE = {"바다": "beach", "산": "mountain", "공원": "park", "학교": "school", "노을": "sunset", "눈": "snow", "꽃": "flower", "고양이": "cat", "강아지": "dog", "음식": "food", "생일": "birthday", "결혼식": "wedding", "여행": "trip", "가족": "family", "영수증": "receipt"}
PARTICLES = ("에서는", "에서", "으로", "에게", "까지", "부터", "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "로")
SYNONYMS = [["sea", "beach", "coast", "shore"], ["car", "automobile", "vehicle"], ["kid", "child", "children"], ["receipt", "invoice", "bill"], ["dusk", "sunset"]]
TEMPLATES = ("a photo of {}", "a picture showing {}")
MONTHS = "january february march april may june july august september october november december".split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
DAYS_KO = "월 화 수 목 금 토 일".split()
DAYPARTS = ("dawn", "morning", "noon", "afternoon", "evening", "night")
DAYPARTS_KO = {"새벽": "dawn", "아침": "morning", "오전": "morning", "점심": "noon", "정오": "noon", "오후": "afternoon", "낮": "afternoon", "저녁": "evening", "심야": "night", "야간": "night", "밤": "night"}
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "한": 1, "두": 2, "세": 3, "네": 4}
