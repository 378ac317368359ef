"""Names, word lists and patterns that results depend on, in natural order."""

from __future__ import annotations

# The 17 regions in the order of reports, and the shard that reports each.
REGIONS = ["서울", "경기", "인천", "대전", "세종", "충북", "충남", "부산", "대구", "울산", "경북", "경남", "강원", "광주", "전북", "전남", "제주"]
SHARDS = {
    "seoul": ["서울"],
    "capital_central": ["경기", "인천", "대전", "세종", "충북", "충남"],
    "east": ["부산", "대구", "울산", "경북", "경남", "강원"],
    "southwest": ["광주", "전북", "전남", "제주"],
}

# Spellings of each region.
REGION_SPELLINGS = {
    "서울": ["서울특별시", "서울시", "서울"],
    "부산": ["부산광역시", "부산시", "부산"],
    "대구": ["대구광역시", "대구시", "대구"],
    "인천": ["인천광역시", "인천시", "인천"],
    "광주": ["광주광역시", "광주시", "광주"],
    "대전": ["대전광역시", "대전시", "대전"],
    "울산": ["울산광역시", "울산시", "울산"],
    "세종": ["세종특별자치시", "세종시", "세종"],
    "경기": ["경기도", "경기"],
    "강원": ["강원특별자치도", "강원도", "강원"],
    "충북": ["충청북도", "충북"],
    "충남": ["충청남도", "충남"],
    "전북": ["전북특별자치도", "전라북도", "전북"],
    "전남": ["전라남도", "전남"],
    "경북": ["경상북도", "경북"],
    "경남": ["경상남도", "경남"],
    "제주": ["제주특별자치도", "제주도", "제주"],
}
ALIASES = {spelling: region for region, spellings in REGION_SPELLINGS.items() for spelling in spellings}
# The integrated city, whose districts decide the region.
INTEGRATED = ["전남광주통합특별시", "전남광주시", "전남광주"]
GWANGJU_DISTRICTS = ["동구", "서구", "남구", "북구", "광산구"]
# Districts of Seoul.
SEOUL_DISTRICTS = [
    "종로구", "중구", "용산구", "성동구", "광진구", "동대문구", "중랑구", "성북구", "강북구", "도봉구", "노원구", "은평구", "서대문구", "마포구", "양천구", "강서구", "구로구", "금천구", "영등포구", "동작구",
    "관악구", "서초구", "강남구", "송파구", "강동구",
]

# Words of purposes that are meals, and of those that are not (first rule set).
MEAL_WORDS = ["간담회", "식사", "오찬", "만찬", "석식", "중식", "조찬", "회식", "급식", "회의", "격려", "접대", "초청"]
NOT_MEAL_WORDS = [
    "구입", "구매", "물품", "상품권", "선물", "기념품", "화환", "조화", "경조", "부의", "축의", "배송", "커피", "원두", "도시락", "케이크", "떡", "간식", "음료", "생수", "다과", "비품", "용품",
]
# The second rule set, whole.
MEAL_WORDS_2 = ["간담회", "식사", "오찬", "만찬", "석식", "중식", "조찬", "회식", "급식", "회의", "격려", "접대", "초청", "협의", "업무협의", "간담"]
NOT_MEAL_WORDS_2 = [
    "구입", "구매", "물품", "상품권", "선물", "기념품", "화환", "조화", "경조", "부의", "축의", "배송", "커피", "원두", "도시락", "케이크", "떡", "간식", "음료", "생수", "다과", "비품", "용품",
    "수수료", "유류", "주유", "차량", "수리", "인쇄", "복사", "도서", "우편", "택배",
]
# Names that contain one of these are no restaurants.
NOT_RESTAURANT_WORDS = [
    "마트", "쿠팡", "편의점", "cu ", "gs25", "세븐일레븐", "이마트", "홈플러스", "롯데마트", "백화점", "온라인", "배달", "문구", "꽃", "화원",
    "플라워", "떡집", "제과", "베이커리", "과자점", "빵", "바게트", "바게뜨", "뚜레쥬르", "던킨", "크리스피크림", "와플", "디저트", "카페", "커피",
    "스타벅스", "투썸", "파스쿠찌", "이디야", "할리스", "폴바셋", "커피빈", "메가엠지씨", "컴포즈", "바나프레소", "블루보틀", "테라로사",
    "엔제리너스", "탐앤탐스", "빽다방", "더벤티", "매머드", "공차", "설빙", "배스킨", "팀홀튼", "티하우스", "티룸", "아티제", "가배", "스패뉴",
    "매점", "카페테리아", "구내식당", "푸드테크", "푸드서비스", "푸드시스템", "푸드빌", "에프앤비", "f&b", "케이터링", "다이소", "약국", "병원",
    "택시", "주유", "주차", "상품권", "페이", "주식회사", "㈜", "(주)", "유한회사", "(유)", "농협", "하나로", "슈퍼", "정육점", "청과", "도매",
    "유통", "물산", "상사", "네이버", "11번가", "지마켓", "옥션", "인터파크", "티몬", "위메프", "컬리", "배민", "요기요", "우체국", "은행",
    "서울시청", "서울특별시청", "센터", "협회", "재단", "학교", "대학", "티켓", "예매", "공연", "극장", "영화", "cgv", "메가박스",
]
# Third rule set (places, purposes that are none, purposes that are, places that tell a meal).
PLACES_OUT_3 = [
    "마트", "슈퍼", "편의점", "이마트", "홈플러스", "롯데마트", "하나로마트", "코스트코", "트레이더스", "백화점", "아울렛", "다이소", "쿠팡", "네이버페이", "인터파크", "11번가", "지마켓", "옥션", "위메프", "티몬",
    "문구", "알파문구", "모닝글로리", "사무용품", "드림디포", "오피스디포", "인쇄", "복사", "제본", "화방", "화원", "꽃집", "플라워", "화훼", "농원", "조경", "베이커리", "제과", "빵집", "파리바게뜨", "뚜레쥬르",
    "던킨", "크리스피", "카페", "커피", "스타벅스", "투썸플레이스", "이디야", "메가커피", "빽다방", "컴포즈", "엔제리너스", "할리스", "폴바셋", "약국", "병원", "의원", "치과", "한의원", "은행", "농협", "수협",
    "신협", "새마을금고", "우체국", "주유소", "충전소", "정비", "카센터", "주차장", "㈜", "주식회사", "(주)", "(유)", "사단법인", "재단법인", "협회", "학회", "공단", "공사",
]
PURPOSES_OUT_3 = [
    "구입", "구매", "물품", "상품권", "온누리상품권", "선물", "기념품", "화환", "조화", "꽃", "축하", "조의", "경조", "배송", "택배", "우편", "원두", "케이크", "떡", "다과", "음료", "간식", "비품",
    "용품", "사무용품", "도서", "인쇄", "구독", "수수료", "주차", "주유", "차량",
]
PURPOSES_IN_3 = [
    "식사", "오찬", "만찬", "석식", "중식", "조찬", "회식", "급식", "간담회", "회의", "접대", "초청", "면담", "격려", "노고", "위로", "토론", "평가회", "보고회", "워크숍", "워크샵", "세미나", "당직",
    "비상근무",
]
PLACES_IN_3 = ["식당", "가든", "한우", "갈비", "횟집", "반점", "순대", "밥상", "냉면", "찌개", "구이", "삼계탕", "면옥", "보쌈", "육회", "국밥", "장어", "분식"]
# Fourth rule set.
PLACES_NONE_4 = ["-", "집무실", "소장", "관내", "상황실", "회의실"]
PLACES_OUT_4 = [
    "스타벅스", "투썸플레이스", "이디야", "메가커피", "컴포즈", "카페", "커피", "베이커리", "제과", "떡집", "호두과자", "이마트", "홈플러스", "롯데마트", "하나로마트", "트레이더스", "마트", "기프트", "화원", "농원",
    "꽃집", "문구", "오피스",
]
MEALS_4 = ["오찬", "만찬", "식사"]
PURPOSES_OUT_4 = [
    "축의금", "조의금", "부의금", "경조사비", "축하금", "격려금", "화환", "꽃다발", "기념품", "선물", "축하물품", "축의물품", "다과", "간식", "차담", "음료", "커피", "생수", "사무용품", "문구", "비품",
    "도서", "수수료", "임차",
]
PURPOSES_IN_4 = ["간담회", "오찬", "만찬", "식사", "협의회", "회의", "격려", "노고"]
PLACES_IN_4 = [
    "식당", "복국", "횟집", "곰탕", "갈비", "한우", "밥상", "쌈밥", "깍두기", "도시락", "정식", "요리", "삼계탕", "설렁탕", "국수", "돼지", "구이", "반점", "식육", "추어탕", "해물", "찌개",
]
TALKS_4 = ["간담", "회의", "논의", "협의"]
MANY_PLACES = [r"(?:외|등)\s*\d+\s*(?:개소|곳|점|건|명|인)", r"\d+\s*개소", r"(?:외|등)\s*[1-9]\b", r"\b등\s*\d+"]

# Marks of companies at either end of a name.
COMPANY_MARKS = ["주식회사", "(주)", "㈜", "유한회사", "(유)", "합자회사", "(합)", "농업회사법인", "영농조합법인"]

# Dishes that a name or category may tell, first spelling first (client), and the photo queries (server).
MENUS = [
    ["김밥"], ["냉면"], ["돈가스", "돈까스"], ["초밥"], ["국밥"], ["설렁탕"], ["칼국수"], ["햄버거"], ["피자"], ["치킨"],
    ["떡볶이"], ["샤브샤브"], ["갈비탕"], ["짜장면", "자장면"], ["쌀국수"], ["마라탕"], ["파스타"], ["곱창"], ["삼계탕"], ["보쌈"],
]
PHOTO_QUERIES = [
    ("김밥", "gimbap korean rice roll"),
    ("냉면", "naengmyeon korean cold noodles"),
    ("돈가스|돈까스", "tonkatsu pork cutlet"),
    ("초밥", "sushi japanese food"),
    ("국밥", "gukbap korean soup rice"),
    ("평양순대국|순대국|순댓국|순대", "sundaeguk Korean blood sausage soup"),
    ("설렁탕", "seolleongtang korean ox bone soup"),
    ("칼국수", "kalguksu korean noodle soup"),
    ("햄버거", "hamburger meal"),
    ("피자", "pizza meal"),
    ("치킨", "korean fried chicken"),
    ("떡볶이", "tteokbokki korean spicy rice cake"),
    ("샤브샤브", "shabu shabu hot pot"),
    ("갈비탕", "galbitang korean beef soup"),
    ("짜장면|자장면", "jajangmyeon black bean noodles"),
    ("짬뽕", "jjambbong Korean spicy seafood noodles"),
    ("탕수육", "tangsuyuk Korean sweet sour pork"),
    ("쌀국수", "vietnamese pho noodles"),
    ("마라탕", "malatang spicy hot pot"),
    ("파스타", "pasta meal"),
    ("곱창", "gopchang korean grilled intestine"),
    ("삼계탕", "samgyetang korean chicken soup"),
    ("보쌈", "bossam korean pork wraps"),
]
CHINESE = "중식|중국|중화"
CHINESE_QUERIES = ["jajangmyeon black bean noodles", "jjambbong Korean spicy seafood noodles", "tangsuyuk Korean sweet sour pork"]
CATEGORY_QUERIES = [
    ("비빔국수|국수", "bibim guksu korean noodles"),
    ("삼겹살", "samgyeopsal korean pork belly"),
    ("찜닭|닭요리", "jjimdak korean braised chicken"),
    ("두부", "korean tofu meal"),
    ("오뎅|어묵", "korean fish cake eomuk"),
    ("해물|생선|회|수산", "seafood platter"),
    ("고기|육류|갈비", "korean barbecue meat"),
    ("한식뷔페|뷔페", "korean buffet food"),
    ("치킨|닭", "chicken food meal"),
    ("카페|커피|디저트|베이커리", "cafe dessert food"),
    ("아시아|베트남|태국|인도", "asian food meal"),
    ("일식|우동|라멘", "japanese food meal"),
    ("중식|중국|짬뽕", "chinese food meal"),
    ("양식|스테이크", "western food meal"),
    ("분식", "korean street food"),
    ("한식|찌개|탕|구이|족발", "korean food meal"),
]
BROAD_QUERIES = [
    ("일식|우동|라멘", "japanese food meal"),
    ("중식|중국|짬뽕", "chinese food meal"),
    ("양식|스테이크", "western food meal"),
    ("카페|커피|디저트|베이커리", "cafe dessert food"),
    ("아시아|베트남|태국|인도", "asian food meal"),
    ("한식|분식|뷔페", "korean food meal"),
    ("술집|오뎅|어묵", "korean street food"),
]
ANY_QUERY = "restaurant food meal"
# What a photo's title must say for a query that has the marker.
TITLE_PATTERNS = [
    ("naengmyeon", "naengmyeon|naengmyun|cold noodle"),
    ("gimbap", "gimbap|kimbap|김밥"),
    ("tonkatsu", "tonkatsu|pork cutlet|돈가스|돈까스"),
    ("sushi", "sushi|초밥"),
    ("gukbap", "gukbap|soup rice|국밥"),
    ("sundaeguk", "sundaeguk|soondae|blood sausage soup|순대"),
    ("seolleongtang", "seolleongtang|ox bone soup|설렁탕"),
    ("kalguksu", "kalguksu|knife cut noodle|칼국수"),
    ("tteokbokki", "tteokbokki|rice cake|떡볶이"),
    ("jajangmyeon", "jajang|black bean noodle|짜장|자장"),
    ("jjambbong", "jjambbong|jjamppong|spicy seafood noodle|짬뽕"),
    ("tangsuyuk", "tangsuyuk|sweet sour pork|탕수육"),
    ("samgyeopsal", "samgyeopsal|pork belly|삼겹살"),
    ("jjimdak", "jjimdak|braised chicken|찜닭"),
    ("tofu", "tofu|dubu|두부"),
    ("fish cake|eomuk", "fish cake|eomuk|odeng|어묵|오뎅"),
    ("seafood platter", "seafood|fish|oyster|shrimp|prawn|crab|lobster|squid|octopus|clam|shellfish"),
    ("barbecue meat", "barbecue|bbq|meat|beef|pork|steak|갈비|고기"),
    ("bibim guksu", "bibim|guksu|korean noodle|국수"),
]
# Dishes for each situation.
SITUATIONS = {
    "든든한 식사": ["국밥", "설렁탕", "갈비탕", "삼계탕", "샤브샤브", "칼국수", "냉면", "비빔밥", "백반", "찌개", "전골", "덮밥", "쌀국수", "짜장면", "자장면", "마라탕", "파스타"],
    "간단하게": ["김밥", "떡볶이", "토스트", "샌드위치", "샐러드", "라면", "우동", "분식"],
    "패스트푸드": ["햄버거", "버거", "피자", "치킨", "핫도그"],
    "디저트·카페": ["커피", "카페", "디저트", "케이크", "아이스크림", "빙수", "빵", "베이커리", "와플", "도넛"],
    "회식·모임": ["곱창", "보쌈", "족발", "샤브샤브", "삼겹살", "갈비", "고기", "전골", "회", "치킨", "피자"],
    "야식": ["치킨", "피자", "떡볶이", "곱창", "보쌈", "족발", "닭발", "라면"],
}
# Region names that are not counted as used.
NOT_REGIONS = ["현재 위치", "지정 지역"]

# Words of header cells by what they stand for, in the order in which a cell is read, and what a column of each is worth.
HEADER_WORDS = {
    "date": ["일자", "일시", "날짜", "집행일", "사용일", "일자(일시)", "사용일자", "집행일자", "집행일시", "사용일시"],
    "purpose": ["집행목적", "사용목적", "목적", "집행내역", "사용내역", "내역", "적요", "내용", "사용목적(내역)"],
    "amount": ["집행금액", "사용금액", "금액", "지출액", "지출금액", "집행액", "사용액", "금액(원)", "집행액(원)", "사용금액(원)"],
    "place": ["집행장소", "사용장소", "장소", "상호", "가맹점", "사용처", "업소명", "거래처명", "거래처", "가맹점명", "식당명", "사용장소(가맹점명)"],
    "address": ["소재지", "주소", "가맹점주소", "사업장주소", "식당주소", "소재지(주소)"],
    "department": ["부서명", "담당부서", "소속부서", "부서", "집행부서", "사용부서", "기관명", "부서(기관명)", "기관(부서)명"],
}
HEADER_WORTH = {"date": 2, "purpose": 2, "amount": 2, "place": 3, "address": 2, "department": 1}
HEADER_ROWS = 15
# Labels of a unit above a table, in the order in which they are tried, and how a unit's name ends there.
UNIT_LABELS = ["부서(기관명)", "기관(부서)명", "소속부서", "담당부서", "작성부서", "부서명", "집행부서", "기관명", "부서"]
UNIT_NAME = r"([A-Za-z0-9가-힣]+(?:과|과장|담당관|관|센터|사업소|소방서|위원회|읍|면|동|실|실장|국|국장|단|단장|본부|본부장|처|처장|대변인))"
UNIT_AFTER_LABEL = r"\s*[:：\-]\s*([A-Za-z0-9가-힣\s\(\)]+)"
# The first bytes of files that are locked or are web pages instead of documents.
LOCKED_MARKS = ["DRMONE", "Fasoo DRM"]
PAGE_MARKS = ["<html", "<head", "<script"]
# The region of each city and district, in the order in which they are looked for; districts of several regions, and those.
DISTRICTS = {
    "경기": [
        "수원시", "장안구", "권선구", "팔달구", "영통구", "성남시", "수정구", "중원구", "분당구", "의정부시", "안양시", "만안구", "동안구", "부천시", "원미구", "소사구", "오정구",
        "광명시", "평택시", "동두천시", "안산시", "상록구", "단원구", "고양시", "덕양구", "일산동구", "일산서구", "과천시", "구리시", "남양주시", "오산시", "시흥시", "군포시",
        "의왕시", "하남시", "용인시", "처인구", "기흥구", "수지구", "파주시", "이천시", "안성시", "김포시", "화성시", "광주시", "양주시", "포천시", "여주시", "연천군", "가평군", "양평군",
    ],
    "인천": ["미추홀구", "연수구", "남동구", "부평구", "계양구", "강화군", "옹진군"],
    "대전": ["유성구", "대덕구"],
    "충북": ["청주시", "상당구", "서원구", "흥덕구", "청원구", "충주시", "제천시", "보은군", "옥천군", "영동군", "증평군", "진천군", "괴산군", "음성군", "단양군"],
    "충남": [
        "천안시", "동남구", "서북구", "공주시", "보령시", "아산시", "서산시", "논산시", "계룡시", "당진시", "금산군", "부여군", "서천군", "청양군", "홍성군", "예산군", "태안군",
    ],
    "서울": [
        "종로구", "용산구", "성동구", "광진구", "동대문구", "중랑구", "성북구", "강북구", "도봉구", "노원구", "은평구", "서대문구", "마포구", "양천구", "강서구", "구로구", "금천구",
        "영등포구", "동작구", "관악구", "서초구", "강남구", "송파구", "강동구",
    ],
}
SHARED_DISTRICTS = {"중구": ["인천", "대전", "서울"], "서구": ["인천", "대전"], "동구": ["대전"]}
# How the provinces of one rule set are written, in the order in which they are looked for.
PROVINCES = {
    "경기": "경기도", "경기도": "경기도", "인천": "인천광역시", "인천광역시": "인천광역시", "대전": "대전광역시", "대전광역시": "대전광역시",
    "세종": "세종특별자치시", "세종특별자치시": "세종특별자치시", "세종시": "세종특별자치시", "충북": "충청북도", "충청북도": "충청북도", "충남": "충청남도", "충청남도": "충청남도",
    "서울": "서울특별시", "서울특별시": "서울특별시",
}
PROVINCE_TWICE = r"^(경기도|인천광역시|대전광역시|충청북도|충청남도)(?:\s+\1)+"
SEJONG_REPEATED = r"^(?:세종특별자치시|세종시)(?:\s+(?:세종특별자치시|세종시))+"
NUMBERED = r"([가-힣\d]+(?:로|길|동|리|가))(?:\s+\d+번?길)?\s+(\d+(?:-\d+)?)"
# Categories of businesses that are no restaurants, of which the name of a category may contain one.
CATEGORIES_OUT = [
    "카페", "커피", "음료", "차담", "전통차", "다방", "주스", "제과", "베이커리", "빵", "떡", "도넛", "아이스크림", "디저트",
    "마트", "슈퍼", "식료품", "유통", "편의점",
]
# A branch at the end of a name.
BRANCH = r"^(.*?)\s*[\(\[\-]?\s*([가-힣a-zA-Z0-9]+(?:점|호점))\s*[\)\]]?$"
# Patterns of what goes from names before they are compared or shown.
REGISTRY_MARKS = r"주식회사|유한회사|\(주\)|㈜"
NOT_NAME = "[^가-힣a-z0-9]"
MARK_FIRST = r"^(\((주|유)\)|\(사\)|\(재\)|주식회사|유한회사)"
MARK_LAST = r"(\((주|유)\)|\(사\)|\(재\))$"
QUOTES_AROUND = "^[\"'`‘“]+|[\"'`’”]+$"
BRACKETED = r"\([^)]*\)|\[[^\]]*\]"
MAIN_BRANCH = "본점|직영점"
COUNTRY = "대한민국|south korea"
QUOTES_AND_SPACES = "^[\"'`‘“\\s]+|[\"'`’”\\s]+$"
OTHERS = r"\s*외\s*\d+.*$"
SHOWN_MARK = r"^(\((주|유)\)\s*|주식회사\s*)"
ADDRESS_IN_BRACKETS = r"\([^)]*(시|구|동|로|길|\d{2,4}-\d{3,4})[^)]*\)"
PHONE = r"0\d{1,2}[- )]?\d{3,4}[- ]?\d{4}"
PERSON_FIRST = r"^[가-힣]{2,4}\s*[,/]\s*"
PERSON_LAST = r"\s*[,/]\s*[가-힣]{2,4}\s*$"
# Patterns of units: what stands before a name, a name with a note, a note about a form, a title's unit, heads of regions.
UNIT_BULLET = r"^[□○※\-*\s]+"
UNIT_FORM = r"^(?:붙임|서식|별지|게시용)[\s_)\]:]*"
UNIT_TAG = r"^\[[^\]]*\]\s*"
UNIT_WITH_NOTE = r"^([A-Za-z0-9가-힣\s]+?)\s*\([^)]*\)$"
UNIT_IN_BRACKETS = r"^[(\[<](.+?)[)\]>]$"
UNIT_FORM_NOTE = r"^\([^)]*?(?:서식|붙임|게시용)[^)]*?\)\s*"
UNIT_OF_PERIOD = r"^\d+(년|월|분기)|^[상하]반기"
UNIT_HONORIFIC = "(담당관|대변인|관)님$"
HEAD_OF_REGION = "(?:도지사|시장|부시장|부지사)(?:실)?$"
TITLE_BRACKET = r"[(\[]([^()\[\]]+)[)\]]"
TITLE_LEAD = r"(?:^|^\d{4}년\s*(?:\d{1,2}월\s*)?|^\d{1,2}월\s*)([A-Za-z0-9가-힣]+)\s+(?:업무추진비|시책|기관운영|집행내역)"
OWN_INSTITUTION = r"([가-힣]+(?:소방서|대학교|대학))"
# The region of each district of the southwest, and where an address with words before it begins.
SOUTHWEST_DISTRICTS = {
    "광주": ["동구", "서구", "남구", "북구", "광산구"],
    "전북": ["전주시", "군산시", "익산시", "정읍시", "남원시", "김제시", "완주군", "진안군", "무주군", "장수군", "임실군", "순창군", "고창군", "부안군"],
    "전남": [
        "목포시", "여수시", "순천시", "나주시", "광양시", "담양군", "곡성군", "구례군", "고흥군", "보성군", "화순군", "장흥군", "강진군", "해남군", "영암군",
        "무안군", "함평군", "영광군", "장성군", "완도군", "진도군", "신안군",
    ],
    "제주": ["제주시", "서귀포시"],
}
SOUTHWEST_START = r"(전남광주통합특별시|광주광역시|전북특별자치도|전라북도|전라남도|제주특별자치도|제주도|[가-힣]{1,5}(?:시|군|구)\s|[가-힣A-Za-z0-9·]+(?:로|길)\s?\d)"
