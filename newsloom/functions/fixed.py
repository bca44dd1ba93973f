"""Fixed values that results depend on: word lists, tables, patterns and limits, as plain text in their natural order."""

from __future__ import annotations

# --- tables of names ---------------------------------------------------------------------------

CATEGORIES = ("정치", "경제", "사회", "생활/문화", "세계", "바둑", "기타")
EXCLUDED_FROM_GENERAL = ("바둑", "IT/과학")
NAVER_SECTIONS = {"100": "정치", "101": "경제", "102": "사회", "103": "생활/문화", "104": "세계"}
NAVER_OUTLETS = {
    "001": "연합뉴스", "003": "뉴시스", "005": "국민일보", "008": "머니투데이", "009": "매일경제", "011": "서울경제",
    "014": "파이낸셜뉴스", "015": "한국경제TV", "016": "헤럴드경제", "018": "이데일리", "020": "동아일보", "021": "문화일보",
    "022": "세계일보", "023": "조선일보", "025": "중앙일보", "028": "한겨레", "032": "경향신문", "052": "YTN", "055": "SBS",
    "056": "KBS", "057": "MBN", "081": "서울신문", "082": "부산일보", "087": "강원일보", "092": "부산MBC", "119": "데일리안",
    "214": "MBC", "215": "한국경제", "277": "아시아경제", "079": "노컷뉴스", "293": "블로터", "366": "조선비즈",
    "374": "SBS Biz", "421": "뉴스1", "448": "TV조선",
}
HOST_OUTLETS = {
    "cctoday.co.kr": "충청투데이", "econovill.com": "이코노믹리뷰", "etnews.com": "전자신문", "ichannela.com": "채널A",
    "imaeil.com": "매일신문", "kids.donga.com": "어린이동아", "mbn.mk.co.kr": "MBN", "ppss.kr": "ㅍㅍㅅㅅ",
    "topstarnews.net": "톱스타뉴스", "yna.co.kr": "연합뉴스",
}
SOURCE_OUTLETS = {"NAVER": "네이버 뉴스", "DAUM": "다음 뉴스", "KAKAO": "다음 뉴스", "GOOGLE": "Google 뉴스"}
BLOCKED_HOSTS = (
    "dcinside.com", "tistory.com", "blog.naver.com", "cafe.naver.com", "fmkorea.com", "theqoo.net", "ruliweb.com",
    "clien.net", "ppomppu.co.kr", "instiz.net", "youtube.com", "namu.wiki",
)
WRAPPER_HOSTS = ("news.google.com",)

# --- words that do not tell stories apart ---------------------------------------------------------

TITLE_STOPWORDS = (
    "오늘", "이번", "관련", "전국", "한국", "속보", "단독", "종합", "현장", "인터뷰", "뉴스", "기자", "사진", "영상",
    "오전", "오후", "올해", "지난", "최초", "국내", "우리", "대한", "이날", "이후", "이상", "대해", "통해", "위해",
)
TOPIC_STOPWORDS = (
    "관련", "사건", "소식", "뉴스", "보도", "발표", "전략", "시장", "전환", "전망", "우려", "결과", "영향", "추진",
    "참여", "진행", "오늘", "이번", "한국", "중국", "미국", "일본",
)
RELEVANCE_STOPWORDS = (
    "관련", "이번", "오늘", "대한", "통해", "앞두고", "공개", "발표", "논란", "정부", "한국", "전국", "부터", "까지",
    "위한", "있는", "없는", "기록", "완성",
)
ISSUE_GENERIC = (
    "바둑", "대회", "바둑대회", "전국", "전국바둑대회", "리그", "바둑리그", "기전", "결승", "우승", "개최", "출범", "진출",
    "확정", "달성", "대국", "정규리그", "최강전", "기성전", "한국", "랭킹", "1위", "연속", "통산",
)
ISSUE_DIVISIONS = (
    "영재", "어린이", "유소년", "청소년", "초등", "중등", "고등", "대학", "시니어", "장애인", "여자", "남자", "아마", "프로", "노인",
)
ISSUE_KEY_NAMES = ("신진서", "최정", "박정환", "변상일", "커제", "구쯔하오", "이세돌", "김은지", "카타고", "한돌", "NHN", "한국기원", "대한바둑협회")
ISSUE_KEY_STOPWORDS = ("오늘", "이번", "관련", "전국", "한국", "중국", "세계", "프로", "기사", "대국", "승리", "패배", "소식", "전망", "발표", "바둑")
FOREIGN_PLACES = ("일본", "중국", "미국", "러시아", "유럽", "프랑스", "독일", "영국", "인도", "태국", "베트남")
KOREAN_PLACES = (
    "서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "경기", "강원", "충북", "충남", "전북", "전남", "경북",
    "경남", "제주", "완주", "완도",
)

# --- phrases and patterns ---------------------------------------------------------------------------

SUMMARY_PHRASES = ("글자크기", "글자 크기", "본문 내용은", "섹션으로 분류했습니다", "섹션 정보는", "중복 분류할 수 있")
TITLE_PHRASES = ("시세 조회로", "현명한 투자하세요", "숙소 환급 상세 안내", "자동차월드")
CUT_MARKERS = ("함께 찾은 검색어", "이 시각 추천뉴스", "많이 본 뉴스", "관련기사", "기사 더보기", "해당 언론사로 이동합니다", "뉴시스에서 직접 확인하세요")
NUMBERING = r"^\s*(?:\d{1,2}[.)]|[①-⑳]|[-•▪▶])\s*"
ENTITIES = {
    "nbsp": " ", "middot": "·", "bull": "•", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "copy": "©", "reg": "®", "trade": "™",
}
PARTICLES = "은는이가을를와과의에도만"
LONG_PARTICLES = (
    "에서도", "에서는", "에서만", "에서", "에게서", "에게도", "에게", "에는", "이라고", "이라는", "라고는", "으로서", "으로써",
    "으로는", "으로도", "로서", "로써", "까지도", "까지는", "까지", "부터는", "부터", "처럼", "만큼", "조차", "마저",
)
JOINED_WORDS = ((r"([가-힣]+(?:초등|중|고등))\s+학교", r"\1학교"), (r"바둑\s+협회", "바둑협회"), (r"대국\s+료", "대국료"), (r"접\s+바둑", "접바둑"))
JUNK_LINE = (
    r"기사\s*제목과\s*주요\s*문장을\s*기반으로.*결과입니다",
    r"(?:자동\s*요약|요약보기|음성으로\s*듣기|음성재생\s*설정|번역\s*(?:beta|베타)|타임톡)",
    r"(?:무단전재|재배포\s*금지|저작권자|Copyright|인터넷신문윤리위원회|한국기자협회)",
    r"(?:제보|문의).*(?:전화|이메일|메일|카카오톡|카톡|jebo)",
    r"(?:전화|이메일|메일|카카오톡|카톡|jebo).*(?:제보|문의)",
    r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}",
    r"^(?:입력|수정)\s*\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}",
    r"^\s*(?:사진|자료사진|동영상|광고|ADVERTISEMENT)\s*$",
    r"(?:구독|좋아요|공감|댓글)\s*(?:버튼|하기|눌러)",
    r"(?:^|\s)편집국\s+[A-Z][a-z]+\s+\d{1,2},\s*\d{4}.*완독",
    r"완독\s*약?\s*\d+\s*분\s*소요",
)
POISON = (
    r"(?:var\s+\w+|function\s*\(|=>|updateLive|setTimeout|\bconst\s+|\blet\s+)",
    r"(?:송고\s*\d{4}|입력\s*\d{4}|수정\s*\d{4}|생방송\s*뉴스|FM\s*\d|완독\s*약)",
    r"(?:텔레그램\s*채널|구독\s*상품|내구독|보관함|하이라이트/메모|제보로\s*함께)",
    r"(?:기사의?\s*본문\s*내용|글자\s*크기(?:로)?\s*변경|본문\s*글씨\s*크기|인쇄하기|공유하기)",
    r"(?:주요\s*뉴스를\s*전해|뉴스를\s*모아|뉴스\s*서비스를\s*제공|놓쳐버린\s*주요\s*뉴스)",
    r"(?:주요\s*뉴스와\s*현안을\s*정리|오늘의\s*주요\s*뉴스|뉴스\s*브리핑)",
    r"(?:주요\s*뉴스\s*(?:와|및)?\s*이슈를\s*모아|한\s*주간\s*세계\s*주요\s*뉴스|바쁘고\s*소란스러운\s*나날)",
    r"(?:【\s*앵커\s*】|\[\s*앵커\s*\]|진행자\s*\))",
    r"(?:관련기사|추천뉴스|많이\s*본\s*뉴스|함께\s*본\s*뉴스)",
    r"(?:답글과\s*추천수|자동으로\s*노출됩니다|댓글\s*정책|운영원칙에\s*따라)",
    r"(?:진짜\s*관전\s*포인트|오랜\s*격언|제3의\s*언어|인\s*셈이다|주목할\s*만하다|의미가\s*크다)",
    r"(?:의의가\s*있다|의미를\s*(?:더했다|부여했다)|더\s*빠르게\s*이동하려고\s*발명한\s*기계가\s*자동차)",
    r"&#(?:x[0-9a-f]+|\d+);",
    r"(?:가치가?\s*(?:더욱|한층)\s*높|사고방식과\s*(?:잘\s*)?부합)",
    r"&[a-z][a-z0-9]+;",
    r"(?:\.{3,}|…$)",
)
AI_META = (
    r"(?:죄송하지만|죄송합니다|유감스럽지만)",
    r"제공(?:하신|해\s*주신|해\s*주시면|해주시면|해\s*주세요|해주세요)",
    r"(?:알려|말씀해|보내|공유해|첨부해)\s*주(?:시면|세요)",
    r"(?:원문|기사\s*본문|본문|기사\s*내용)(?:에는|이|은|을|가|만)?\s*(?:포함되어\s*있지\s*않|제공되지\s*않|없어서|없습니다)",
    r"요약(?:을|이)?\s*(?:작성할\s*수\s*없|할\s*수\s*없|불가능)",
    r"요약해\s*드리|요약해드리|도와\s*드리겠|도와드리겠",
    r"제목\s*목록",
    r"섹션으로\s*분류했습니다|섹션\s*정보는|중복\s*분류할\s*수\s*있|언론사(?:가|의)\s*분류|기사\s*섹션\s*분류",
    r"본문\s*듣기를\s*시작합니다|글자\s*크기\s*(?:변경|조절)|구독\s*(?:버튼을|하기를)|앱을?\s*(?:설치|다운)",
)
DEPENDENT_FIRST = r"^(?:그(?:가|는|를|에게)\s|이(?:로써|러한)\s|거치며\s|이어\s|이후\s|둘째[,，]\s*|한편\s|그러면서\s|그리고\s|또한\s|아울러\s|현재는\s)"
DETACHED_PARTICLE = r"(?:^|\s)(?:에서도|에서는|에서|에게서|에게|이라고|이라는|으로서|으로써|로서|로써|까지|부터|처럼|만큼|조차|을|를)(?=\s|$)"
GENERAL_TITLE = (r"\[(?:여백|전라\s*insight|[^\]]*다이어리)\]", r"(?:뉴욕다이어리|\d+강의\s*시선|가볼\s*만한\s*곳)")
GENERAL_ARTIFACT = (
    r"(?:\[[^\]]*기자\]|기자\s*[=｜]|특파원\s*[=｜]|ⓒ|사진\s*(?:=|출처)|스틸컷)",
    r"(?:에서\s*열린|회의에서|행사에서).{0,80}(?:발언|기념촬영|포즈|참석)하고\s*(?:있다|있었다)\.?$",
)
GENERAL_DEPENDENT_FIRST = r"^(?:\[|거치며\s|이어\s|이후\s|둘째[,，]\s*|한편\s|그러면서\s|그는\s|현재는\s)"
GENERAL_BROKEN_NUMBER = r"^\d+(?:[.,]\d+)?%\s*[,，]"
REORDER_DEPENDENT = r"^(?:이후|그러면서|그는|한편|이어|둘째|현재는|사회\s*공헌|첫\s*발제자로|지난\s+\d+일)"
REJECTED_BARE = r"^(?:카타고|바둑)$"
REJECTED_PROMO = r"(?:시세\s*조회로|현명한\s*투자하세요|신청\s*및\s*.*(?:환급|상세)\s*안내|자동차월드)"
REJECTED_EDITORIAL = (
    r"(?:\[?[^\]\n]{0,20}(?:칼럼|사설|기고|시론|논단|오피니언)\]?|\[(?:건설\s*Pick|패트롤)\]|퇴근길\s*이슈|뉴스\s*브리핑"
    r"|뉴스\s*잇\s*\(|뉴스\s*바이트|모닝픽|주요\s*뉴스\s*]|주요뉴스\s*…|미리보는\s*.*신문"
    r"|\d{1,2}월\s*\d{1,2}일\s*['‘]?뉴스\s*9['’]?\s*예고|증시\s*포커스|증시포커스|뉴스\s*새벽배송|\[\s*뉴스\s*(?:\.{2,}|…)|스포츠용어\s*산책)"
)
DEAD_PAGE = r"(?:존재하지\s*않는\s*페이지|요청하신\s*페이지를\s*찾을\s*수\s*없|삭제된\s*기사|기사가\s*존재하지\s*않|page\s*not\s*found|\b404\b)"
BODY_JUNK = (
    r"(?:무단전재|재배포\s*금지|저작권자|구독|로그인|회원가입|제보|관련기사|추천뉴스|많이\s*본\s*뉴스"
    r"|기사제공|기자\s*[A-Z0-9._%+-]+@|기사의?\s*본문\s*내용|글자\s*크기|인쇄하기|공유하기)"
    r"|(?:섹션으로\s*분류했습니다|섹션\s*정보는|중복\s*분류할\s*수\s*있|언론사(?:가|의)\s*분류|기사\s*섹션\s*분류|본문\s*듣기를\s*시작합니다"
    r"|글자\s*크기\s*(?:변경|조절)|SNS\s*보내기|기사\s*공유하기|댓글\s*정책|이\s*기사\s*어때요)"
)
CAPTION = r"^\s*(?:사진|영상|그래픽|ADVERTISEMENT)\s*[=:]"
BODY_CONTAINERS = (
    "dic_area", "article_view", "article-body", "article-veiw-body", "article-view-content", "newsct_article", "article_body",
    "articleBody", "news_body", "news-contents", "view_cont", "newsViewBody", "story-news",
)
TOPIC_RULES = (
    ("사회", "폭행|살인|사망|숨진|경찰|검찰|법원|사건|사고|성매매|성범죄|조폭|검거|재판|수사|학교|교사|학생"),
    ("경제", "증시|주가|금리|환율|기업|투자|금융|부동산|아파트|원유|산업|수출|매출|순이익"),
    ("정치", r"대통령|국회|국회의원|민주당|국민의힘|선거|정당|총리|장관|외교부|정부\s*정책"),
    ("세계", "미국|중국|일본|러시아|이란|유럽|중동|트럼프|해외|국제사회"),
    ("생활/문화", "여행|축제|문화|영화|공연|음식|건강|날씨|관광|스포츠"),
)
SECTION_RULES = (
    ("정치", "정치|국회|대통령"),
    ("경제", "경제|금융|증권|부동산|산업|기업"),
    ("사회", "사회|지역|교육|사건|법원"),
    ("생활/문화", "생활|문화|연예|스포츠|건강|여행"),
    ("세계", "세계|국제|글로벌|해외"),
)
BADUK_TITLE = r"(?:바둑(?:대회|리그|기전|기사|棋士|계)|대국|기전|한국기원|대한바둑협회|신진서|최정\s*9단|카타고|프로기사)"
BADUK_CONTEXT = r"(?:바둑|대국|기전|한국기원|대한바둑협회|프로기사|입단|[1-9]\s*단(?![가-힣])|棋士)"
BADUK_ACTION = r"(?:대국|우승|준우승|결승|본선|예선|출전|승리|패배|개최|개막|입단|바둑판|흑번|백번|수읽기|포석)"
BADUK_SIGNALS = ("바둑", "한국기원", "대한바둑협회", "신진서", r"최정\s*9단", "카타고", r"(?:프로|아마추어)\s*기사", r"(?:본선|결승|예선)\s*대국", "바둑리그")
BADUK_DISPLAY = r"(?:바둑|대국|기전|한국기원|대한바둑협회|프로\s*기사|입단|棋士|신진서|최정(?!만)|박정환|변상일|커제|이세돌|김은지|알파고|카타고|한돌|흑번|백번|포석|수읽기)"
PROMO_TITLE = (
    r"(?i:(?:앱|어플|어플리케이션|프로그램|게임|모바일|PC)\s*(?:무료\s*)?(?:다운(?:로드|받기)?|설치))",
    r"(?:다운로드|설치|가입|충전|쿠폰|머니)\s*(?:방법|링크|하기|받기|안내|총정리)",
    r"바로\s*가기\s*(?:링크|안내)?$",
    r"바둑이\s*(?:게임|사이트|주소|총판|환전|머니|쿠폰|추천|설치|다운|바로\s*가기)",
    r"(?:홀덤|섯다|맞고|슬롯|바카라|카지노|토토|배팅|베팅|먹튀|사설\s*사이트|꽁머니)",
    r"(?:19금|야동|출장\s*(?:마사지|안마)|조건\s*만남)",
    r"(?:무직자|신용불량|일수|급전)\s*대출|대출\s*(?:추천|상담|한도\s*조회)",
    r"(?:코인|주식)\s*(?:리딩방|리딩\s*방)",
)
PROMO_OUTLET = "자동차월드"
TOURNAMENT = "(?:대회|기전|리그|배|선수권|최강전|결정전)"
INCIDENT = "(?:사망|숨져|숨진|사고|화재|폭발|붕괴|실종|피해)"
ISSUE_RESULT = "(?:우승|준우승|결승|진출|승리|패배|개최|개막|폐막|공사|차질|중단|지원|교류|합동훈련|선발|입단)"
ISSUE_EVENT = r"[가-힣A-Za-z0-9]{2,24}(?:바둑)?(?:대회|리그|기전|컵|배|선수권|오픈|스포츠교류|합동훈련)"
ISSUE_PLACE = r"[가-힣]{2,10}(?:시|군|구|읍|면)\s*[가-힣]{0,10}(?:공사|대회|리그)"
STANDALONE_EVENT = r"(?:제\s*\d+회\s*)?([가-힣A-Za-z0-9· ]{2,38}?(?:전국)?(?:바둑)?(?:선수권대회|바둑대회|결정전|챌린지\s*바둑\s*리그|바둑\s*리그))"
NEVER_QUARANTINED = r"(?i)(?:^|\.)(?:baduk\.or\.kr|news\.naver\.com|v\.daum\.net|news\.daum\.net)$"
HOST_FAILURE = r"^(?:non_html|http_(?:403|429|5\d\d))$"
TRACKING_PARAMETER = r"(?i)^(?:utm_|fbclid|gclid|ref|from|sid$)"

# --- limits ---------------------------------------------------------------------------------------

LINE_LENGTH = (24, 190)  # of a summary line
BODY_LENGTH, TITLE_LENGTH, PRESS_LENGTH = 16_000, 300, 40
BODY_OK = 180  # characters from which a body counts as found
SAME_STORY = 0.45
#: The press at the end of a title, and the tag of a column at its start.
TITLE_PRESS = r"\s+[-|–—]\s+[^-|–—]{1,30}$"
SERIES_TAG = r"^\s*(?:\[[^\]]*\]|【[^】]*】|<[^>]*>)\s*"
SUBREQUESTS, PER_CANDIDATE = 44, 4
DAILY_CALLS, RESERVED_CALLS, BOOST_CALLS, RECOVERY_CALLS = 60, 36, 24, 90
DAILY_SPEND, MONTHLY_TARGET, MONTHLY_SPEND = 300_000, 4_750_000, 5_000_000  # micro-USD
PUBLISH_CAP, BATCH = 12, {"baduk": 20, "general": 12}
QUARANTINE_FAILS, QUARANTINE_HOURS, QUARANTINE_RULE = 5, 24, "2"
READ_FUSE = 1_000_000

#: Titles of no issue in particular, as a whole.
MISC_TITLE = r"(?:기타|그 밖의)(?:\s*(?:바둑\s*)?(?:소식|뉴스|이슈))?"

# Fixed values of candidates, ledgers and the limits of single days and months.
GENERIC_TITLES = ("이 시각 주요 뉴스", "오늘의 주요 뉴스", "주요 뉴스", "뉴스 브리핑")
LOCAL_PRESS = r"(?i)(?:충청|대전|세종|청주|충북|충남|전북|전남|경북|경남|강원|제주|부산|울산|경기|인천).*(?:뉴스|일보|신문|투데이)|(?:중부|제주|경인|영남|호남)(?:매일|일보|신문)"
READ_LEDGER = "d1_rows_read:"
TIMELESS_HOST = "baduk.or.kr"
FREE_CALLS = 4
DAY_SPEND = {"2026-08-14": 500_000}
DAY_CALLS = {"2026-08-14": 165}
MONTH_TARGET = {"2026-08": 6_750_000}
MONTH_SPEND = {"2026-08": 7_000_000}
