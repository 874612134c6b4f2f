"""Fixed values of the domain: word lists, units and weights that results depend on."""

STATUS_LABELS = {"SUPPORTED": "근거확인", "PARTIAL": "근거불충분", "UNSUPPORTED": "근거미확인"}
EXCLUDED_HEADERS = ["거래구분", "과목", "금액", "기한", "담보", "신용", "보증인"]
FINANCE_KEYS = ["총자산", "자기자본", "매출액", "영업이익", "순이익", "EBITDA", "유형자산", "현금예금", "총차입금", "이자비용", "부채비율", "차입금의존도"]
UP_WORDS = ["증가", "상승", "확대", "개선", "호전", "증대", "회복", "상회", "흑자", "증익", "증가세", "강화"]
DOWN_WORDS = ["감소", "하락", "축소", "악화", "저하", "감축", "적자", "하회", "감익", "감소세", "약화"]
OPPOSITES = [("증가", "감소"), ("상승", "하락"), ("확대", "축소"), ("개선", "악화"), ("호전", "악화"), ("상회", "하회"), ("흑자", "적자"), ("증익", "감익"), ("강화", "약화"), ("회복", "악화")]
UNITS = ["%p", "%", "％", "백만원", "억원", "원", "배", "개월", "년", "p"]
INDICATORS = ["매출", "매출액", "영업이익", "영업손익", "당기순이익", "순이익", "EBITDA", "총자산", "자기자본", "부채", "부채비율", "자기자본비율", "유동비율", "차입금", "총차입금", "차입금의존도", "이자비용", "이자보상배율", "금융비용", "현금", "현금성자산", "현금예금", "영업활동현금흐름", "현금흐름", "ROA", "ROE", "ROAA"]
METRICS = {
    "매출액": ["매출액", "매출"],
    "영업이익": ["영업이익", "영업손익", "영업이익(손실)", "영업손실"],
    "당기순이익": ["당기순이익", "순이익", "당기순손익", "순손실", "당기순손실"],
    "부채비율": ["부채비율"],
    "유동비율": ["유동비율"],
    "자기자본": ["자기자본", "자본총계"],
    "총자산": ["총자산", "자산총계"],
    "영업이익률": ["영업이익률", "영업이익율"],
    "ROE": ["roe", "자기자본이익률"],
    "ROA": ["roa", "총자산이익률"],
}
#: Money units in won; amounts are held in millions of won.
WON = {"원": 1, "천원": 1_000, "만원": 10_000, "백만원": 1_000_000, "억원": 100_000_000}
STOP_WORDS = ["그리고", "또한", "하지만", "따라서", "즉", "등", "및", "으로", "에서", "대비", "전년", "금년", "당기", "동기", "수준", "기준", "확인", "예정", "관련", "등의"]
TAG_LABELS = {"NUM_MISSING": "숫자 누락", "BIG_NUM_MISSING": "큰 숫자 누락", "DISPERSED": "근거 분산", "PDF_ONLY": "PDF만", "JSON_ONLY": "JSON만", "DIR_CONFLICT": "방향성 모순", "NUM_CONFLICT": "숫자 불일치 의심", "UNIT_MISMATCH": "단위 불일치"}
#: Score weights: similarity, coverage, fact block, proximity, big numbers, unit, direction.
NUMBER_WEIGHTS = (0.32, 0.22, 0.22, 0.12, 0.08, 0.03, 0.01)
TEXT_WEIGHTS = (0.55, 0.40, 0.0, 0.03, 0.0, 0.01, 0.01)
GRADES = [(95, "S"), (90, "A+"), (85, "A"), (80, "A-"), (75, "B+"), (70, "B"), (65, "B-"), (60, "C+"), (55, "C"), (50, "C-")]
