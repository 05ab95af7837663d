"""Word lists and patterns that results depend on, as they are."""

# Korean particles of the retrieval tokeniser, longest first.
PARTICLES = (
    "으로써", "에게서", "이라고", "에서는", "으로는", "에서", "에게", "으로", "라고",
    "까지", "부터", "보다", "처럼", "이나", "마다", "조차", "한테", "와의", "과의",
    "의", "가", "이", "은", "는", "을", "를", "와", "과", "로", "도", "만", "에",
)

# Particles and endings of the key-fact tokeniser, longest first.
SUFFIXES = (
    "으로써", "에게서", "이라고", "에서는", "으로는", "입니다", "습니다", "합니다", "에서", "에게", "으로",
    "라고", "까지", "부터", "보다", "처럼", "이나", "마다", "조차", "한테", "와의", "과의",
    "의", "가", "이", "은", "는", "을", "를", "와", "과", "로", "도", "만", "에",
)

# Words that the key-fact tokeniser leaves out.
STOPWORDS = (
    "및", "등", "그", "저", "것", "수", "때", "경우", "대한", "대하여", "관한", "위하여", "위한",
    "있는", "하는", "그리고", "또는", "또한", "따라", "따른",
)

# Page chrome that line cleaning drops.
CHROME_LINES = (
    "언어지원", "언어지원 메뉴", "메뉴 선택됨", "KOR", "ENG", "JPN", "다운로드", "인쇄하기", "공지사항",
    "권리침해신고안내", "개인정보 처리방침",
)

# Question forms.
ENUMERATION = (
    r"[0-9]+\s*가지|몇\s*가지|몇\s*종류|[한두세네다섯여섯일곱여덟아홉열일이삼사오육칠팔구십]\s*가지|"
    r"열거|나열|각각\s*무엇|모두\s*무엇|어떤\s*것들|종류.{0,8}무엇|항목.{0,8}무엇"
)
YES_NO = r"(우선하여|우선\s*적용|허용되나요|허용됩니까|가능한가요|맞나요|되나요|인가요|있나요|끝나나요|하나요|합니까)\s*\??\s*$"
WH_WORDS = "무엇|어떤|누가|어디|언제|얼마|며칠|몇|어떻게|왜"
# Token budgets by question form.
TOKEN_BUDGET = {"yesno": 256, "single": 288, "multi": 384, "enum": 512}

# Answers that evade.
REFUSAL = r"확인되지\s*않|확인할\s*수\s*없|찾을\s*수\s*없|알\s*수\s*없|명시되어\s*있지\s*않|나와\s*있지\s*않|포함되어\s*있지\s*않|정보가\s*없"
# What answer post-processing takes away. The middle dot U+30FB stays.
PREAMBLE = r"^\s*(답변\s*[:：]|답\s*[:：]|정답\s*[:：])\s*"
FILLER = r"^\s*(?:위\s*조항에\s*따르면|제시된\s*조항에\s*따르면|해당\s*조항에\s*따르면|약관에\s*따르면)\s*[,，]?\s*"
FOREIGN = "[一-鿿぀-ゟァ-ヺ]"

# Scoring weights and cutoffs.
RRF_K = 60
CUTOFF = 4
AXIS_WEIGHTS = {"accuracy": 0.40, "grounding": 0.25, "completeness": 0.20, "clarity": 0.15}
TOTAL_WEIGHTS = {"mrr": 20.0, "keyfact": 30.0, "judge": 50.0}
COST = {"chars_per_token": 1.7, "answer_tokens": 4000 / 1.7 * 0.4, "output_tokens": 300, "usd_in": 1.50, "usd_out": 9.00, "krw": 1430}
