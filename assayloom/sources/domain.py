"""Fixed values of the domain: lists and tables that rules look up, stated as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Numbers that are looked up under another one.
REDIRECTS = (("10361-37-2", "7440-39-3"), ("7761-88-8", "7440-22-4"))
# Chromium and the number that it brings along; the silica family, whose members bring each other and a row without number.
CHROMIUM, CHROMIUM_SIX = "7440-47-3", "18540-29-9"
SILICA = ("7631-86-9", "14808-60-7", "14464-46-1", "15468-32-3")
FORCED_CODE = "2D-10-010"
# Factor overrides, in order: number, what the name holds, factor as one text, factors as a list.
FACTORS = (
    ("1317-65-3", "limestone", "기타광물성분진", ("기타광물성분진",)),
    ("471-34-1", "탄산", "기타광물성분진", ("기타광물성분진",)),
    ("1317-80-2", "금홍석", "기타광물성분진; 이산화티타늄", ("이산화티타늄", "기타광물성분진")),
    ("14807-96-6", "소우프스톤", "소우프스톤", ("활석(석면불포함)", "활석", "소우프스톤")),
)
MINERAL_DUST, MINERAL_DUST_FACTOR = "광물성분진", "기타광물성분진"
# Fixed values of welding: words of a product, iron and its oxide, what is put before, dust by name and by number.
WELDING_WORDS = ("용접", "welding")
IRON, IRON_NAME, IRON_OXIDE, IRON_OXIDE_NAME, FUME = "7439-89-6", "철", "1309-37-1", "산화철(분진, 흄)", "용접흄"
WELDING_SUBJECTS = "용접흄; 산화철(분진, 흄)"
DUST_WORDS = ("분진", "규산", "운모", "석회석", "탄산칼슘", "실리카", "규석", "활석", "소우프스톤", "장석", "펠드스파", "feldspar", "limestone")
DUST_NUMBERS = ("1317-65-3", "471-34-1", "14807-96-6", "68476-25-5")
# A product whose components are given: number, name, content.
FIXED_PRODUCT = (("7439-89-6", "철", "Rem.%"), ("7439-96-5", "망간 및 그 무기화합물", "1~5%"), ("13463-67-7", "이산화티타늄", "10~15%"))
# Products known by all of some words: words, product, targets, components.
EXCEPTIONS = (
    (
        ("연강용 피복아크 용접봉", "CS-200", "CR-13"), "용접재료(연강용 피복아크 용접봉) CR-13", "용접흄; 산화철(분진, 흄); 망간 및 그 무기화합물; 이산화티타늄",
        "13463-67-7(10~15%); 68476-25-5(5~10%); 7439-96-5(1~5%); 1344-09-8(1~5%); 1317-65-3(1~5%); 12001-26-2(1~5%); 7439-89-6(Rem.%)",
    ),
)
# Methods in their order.
METHODS = (
    "누적소음계", "중량분석법", "중량분석법(호)", "중량분석법(흡)", "FTIR법(다)", "위상차현미경법", "중량분석법(단)", "ICP법(다)", "ICP법(다)호", "IC법(단)-금",
    "ICP법(단)흡", "ICP법(단)", "GC법(다)", "GC법(다)2", "GC법(다)3", "GC법(다)4", "GC법(다)5", "GC법(다)6", "GC법(다)7", "GC법(다)8",
    "GC법(단)", "HPLC법(다)", "HPLC법(다)2", "HPLC법(다)3", "HPLC법(다)4", "HPLC법(단)", "IC법(다)-산알", "IC법(다)2-산알", "UV법(다)", "IC법(단)-산알",
    "UV법(단)", "GC법(NPD)(단)", "IC법(다)3-가스", "IC법(단)-가스", "VIS(다)", "추출법", "GC법(단)-C", "HPLC법(단)-C", "ICP법(다)-C", "UV법(단)-C",
    "직독식", "WBGT",
)
UNKNOWN_METHOD = 9999
# Flags of two laws and the words that set them.
OSH_FLAGS = (
    ("is_measured", "작업환경측정대상물질"), ("is_special", "특수건강진단대상물질"), ("is_managed", "관리대상유해물질"), ("is_special_mgmt", "특별관리물질"),
    ("is_permit", "허가대상물질"), ("is_prohibited", "금지물질"),
)
CCA_FLAGS = (("acute", "유독물질"), ("chronic", "관찰물질"), ("accident", "사고대비물질"), ("prohibited", "금지물질"), ("restricted", "제한물질"))
# Words before and in an item's name, and endings of a name's core.
ITEM_PREFIXES = ("측정 비대상", "단시간 및 임시작업", "보관", "허용소비량 미만")
ITEM_TAGS = ("[특별]", "[특검]", "[허가]")
CORE_SUFFIXES = (
    "및 그 가용성 화합물", "및 그 화합물", "및 화합물", " 및 그 가용성 화합물", " 및 그 화합물", " 및 화합물", "(석면불포함)", "석면불포함", " 계열", "계열",
    " 유기화합물", " 무기화합물",
)
# Namespaces of name-based ids.
PROFILE_NAMESPACE, RELATION_NAMESPACE, RULE_NAMESPACE = "9152144b-77e0-4f20-a00e-1550452e8fde", "60ef6a46-2d55-44da-8374-d5e752594116", "78cbfc6e-8509-4720-9702-438a56861dca"

# Numbers of a chain, the reason that each gives for a correction, and words of a completed one.
REASONS = (
    ("1317-65-3", "Limestone ➔ 고시 제15항에 의거 '기타광물성분진' 표준명 세척"),
    ("471-34-1", "탄산칼슘 ➔ '기타광물성분진' 명칭 단일 진실 공급원 통합"),
    ("1317-80-2", "금홍석 ➔ '기타광물성분진; 이산화티타늄' 다중 유해인자 동시 전개"),
    ("14807-96-6", "활석 분지 ➔ 수동 성상 선택 우선 적용권 보장"),
    ("7429-90-5", "알루미늄 ➔ 공정 토큰 스캔 기반 성상 표준 접미사 정형화"),
    ("7440-22-4", "은 분지 ➔ 독성학적 강도별 노출기준 교차 대사 검증"),
)
DONE_WORDS, DONE_MARK, OPEN_MARK = ("기타광물성분진", "소우프스톤", "알루미늄", "활석(석면불포함)"), "✔ [교정 완료] ", "• "
# Tokens of conditions.
ASBESTOS, ASBESTOS_OPEN, ASBESTOS_STATUS, ASBESTOS_CONTEXT = "석면", ("불명", "unknown", "포함"), ("included", "unknown", "포함", "불명"), ("석면 포함", "석면불명", "unknown")
HEAT = ("용접", "welding", "고열", "열절단", "산화")
# Keys and texts that may not leave.
EXPORT_KEYS = r"authorization|api[_-]?key|token|secret|password|private[_-]?key|raw_response|raw_text|prompt|payload|trace_context|file_path"
SENSITIVE_KEYS = r"api[._-]?key|token|secret|password|authorization|private[._-]?key"
SECRET_TEXTS = (
    r"-----BEGIN [^-]+PRIVATE KEY-----", r"\b(Bearer|Basic|Token)\s+[A-Za-z0-9._~+/=-]+", r"\bC:\\Users\\[^\\\s]+\\",
    r"(api[_-]?key|authorization|private[_-]?key)\s*[:=]\s*[^\s,]+",
)
FORBIDDEN_FILES, SHARE_BYTES = ("config.json", "smu_cache.json", "msds_cache_registry.json"), 50 * 1024 * 1024
# Headings, fields and words of a sheet, by the patterns of a page's lines.
HEADING_3, HEADING_4, HEADING_5, HEADING_6 = r"(3|삼)\s*항?.*?([구성|성분|명칭|함량|기재]{2,})", r"(4|사)\s*항?.*?([응급|조치|처치|요령|구급]{2,})", r"(5|오)\s*항?.*?([폭발|화재|소화|대처]{2,})", r"(6|육)\s*항?.*?([누출|사고|방지|대책]{2,})"
EXIT_HEADING = r"4\s*[.:항-]*\s*(응\s*급\s*조\s*치|first\s*aid)"
CONTENT_FIELDS = r"함유량|함량|농도"
# Cells of a table's header, and words of columns that hold no content.
HEADER_CELLS = ("cas", "casno", "cas번호", "cas-no", "함유량", "함량", "content", "구성성분", "화학물질명", "substance", "물질명", "명칭", "chemicalname", "weight")
NOISE_CELLS = ("twa", "stel", "pel", "tlv", "mg/m", "mg/㎥", "노출기준", "exposure")
# What no product's name holds.
NO_PRODUCT, NO_PRODUCT_BARE = ("미추출", "확인", "실패", "오류", "error", "unknown", "none", "null", "N/A"), ("물질안정", "보건자료", "MSDS", "SDS", "안전보건")
#: Words from which the carrier of words draws.
VOCABULARY = (
    "3.구성성분의명칭및함유량", "4.응급조치요령", "5.폭발화재시대처방법", "6.누출사고시대처방법", "성분", "CAS", "함유량", "64-17-5", "67-64-1", "50%", "1~5", "7440-22-4", "polymer", "Solvent", "물질", "note", "12.50", "wt",
    "ingredient", "name", "64-17-6", "Ethanol", "cas번호", "농도", "<2", "고분자", "항목", "first", "aid", "page", "2", "은", "아세톤", "resin", "미만", "비고", "A12", "purity", "clear", "oil", "4.first", "EC", "202-016-5", "X", "etc", "red", "blue", "mix", "7.취급", "end",
)
# Lights and their colours.
LIGHTS = (("🟢", 0x50B000), ("🟡", 0x00C0FF), ("🔴", 0x0000FF), ("🔵", 0xFF7000), ("⚪", 0xA6A6A6))
# Seconds by type of document.
TIMEOUTS = (("text", 180.0), ("mixed", 240.0), ("image", 360.0))

#: Numbers and names from which the carrier of real substances draws.
SUBSTANCES = (
    ("7439-89-6", "철"), ("7439-96-5", "망간 및 그 무기화합물"), ("13463-67-7", "이산화티타늄 (Titanium dioxide)"), ("1309-37-1", "산화철(분진, 흄)"), ("1317-65-3", "석회석 (Limestone)"),
    ("471-34-1", "탄산칼슘"), ("1317-80-2", "금홍석"), ("14807-96-6", "활석(석면불포함)"), ("7440-47-3", "크롬 및 그 화합물"), ("18540-29-9", "6가크롬"), ("7631-86-9", "실리카 (Silica)"),
    ("14808-60-7", "규석"), ("14464-46-1", "크리스토발라이트"), ("15468-32-3", "트리디마이트"), ("10361-37-2", "염화바륨"), ("7761-88-8", "질산은"), ("7440-39-3", "바륨 및 그 가용성 화합물"),
    ("7440-22-4", "은 (가용성 화합물)"), ("67-64-1", "아세톤 (Acetone)"), ("12001-26-2", "운모"), ("68476-25-5", "feldspar"), ("64-17-5", "Ethanol (96%)"), ("", "limestone dust"),
)


def values_sql(name: str, columns: str, rows: tuple[tuple, ...]) -> str:
    """A table of fixed values as a common table expression."""
    shown = lambda v: "true" if v is True else "false" if v is False else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)})"


def table(spark: SparkSession, columns: str, rows: tuple[tuple, ...]) -> DataFrame:
    return spark.createDataFrame(list(rows), columns)


def choose_sql(index: str, values: tuple[str, ...]) -> str:
    """One of values by an integer expression."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({index}) % {len(values)} {whens} END"
