"""Patterns, word lists and thresholds. All may be replaced; the queries over the test tables use words that occur there."""

from __future__ import annotations

from dataclasses import dataclass

# Heading patterns and their depths, in order of precedence.
HEADINGS = (
    (r"^□\s*\(.+?\)", 1),
    (r"^\d+\.\s+", 1),
    (r"^[가나다라마바사아자차카타파하]\.\s+", 2),
    (r"^◦\s+", 3),
    (r"^☐\s+", 3),
    (r"^-\s+", 4),
)
#: What all of them, and hash marks, begin with.
HEADING_SIGNS = r"(?U)^\s*[#□\d가나다라마바사아자차카타파하◦☐-]"
MAX_MARKDOWN_DEPTH = 4
WHOLE_TITLE = "전체 문서"
TITLE_PREFIX = r"^(□\s*\([^)]*\)\s*|\d+\.\s+|[가나다라마바사아자차카타파하]\.\s+|[◦☐]\s+|-\s+)"


# Word lists of the five kinds of evidence.
@dataclass(frozen=True)
class Lexicons:
    comparison: str = r"대비|비교|구분|vs\.?|이상|이하|차이|증감|감소|증가"
    process: str = r"단계|추진|절차|방향|체계|로드맵|과정|프로세스|흐름|순서|계획|방안"
    space: str = r"위치|배치|면적|조망|입지|단면|평면|지도|좌표|부지|지역|공간"
    evidence: str = r"연구|논문|실험|따르면|결과|조사|분석|통계|데이터|수치|측정"
    definition: str = r"\(정의\)|란\?|개요|개념|원리|정의"
    number: str = r"\d+(?:\.\d+)?(?:\s*(?:개|건|명|원|억|만|km|m|㎡|MW|톤|%|년|월|일|회|층))?"


# Words that tell types of figures apart.
@dataclass(frozen=True)
class TypeWords:
    maps: str = "지도|입지|위치|좌표"
    plans: str = "단면|평면|배치|층"
    views: str = "조망|투시|조감|렌더링|3D"
    dates: str = r"\d{4}년|\d{1,2}월|\d{4}"
    numbers: str = r"\d+(?:\.\d+)?"
    trends: str = "추이|추세|변화|연도별|월별|시계열"


# Words that the content of a figure of a type is expected to have.
TYPE_CONTENT = {
    "concept_diagram": ("개념", "정의", "원리", "구조", "체계"),
    "comparison_table": ("비교", "대비", "항목", "구분", "차이"),
    "flow_chart": ("단계", "절차", "흐름", "과정", "순서"),
    "roadmap": ("년", "월", "계획", "일정", "추진"),
    "map_layout": ("위치", "지도", "입지", "지역", "현장"),
    "floor_plan": ("평면", "단면", "배치", "층", "공간"),
    "rendering": ("조감", "투시", "3D", "렌더링", "조망"),
    "bar_chart": ("수치", "통계", "현황", "건", "개"),
    "line_chart": ("추이", "변화", "추세", "연도", "시계열"),
    "photo": ("사진", "현장", "실물", "외관", "모습"),
    "cover_banner": ("표지", "제목", "배너", "로고"),
}

REPORT_TITLE = "분석 결과"


# Labels of a plan written as text.
@dataclass(frozen=True)
class ReportLabels:
    file: str = "파일"
    total: str = "총 글자수"
    baseline: str = "기준 개수"
    final: str = "최종 그림 수"
    summary: str = "분석 요약"
    figures: str = "추천 그림 목록"
    section: str = "섹션"
    place: str = "위치"
    purpose: str = "목적"
    anchor: str = "앵커"
    confidence: str = "신뢰도"
    score: str = "최종 점수"
    votes: str = "투표 수"
    content: str = "구성 요소"
    prompt: str = "이미지 프롬프트"
    meta: str = "메타 정보"


#: Words of the invented prose in the test tables, where the Korean lists match nothing.
PROSE = Lexicons(comparison="the|que", process="and|und", space="ing|eau", evidence="tion|mente", definition="with|avec", number=r"\d+")
# The same for types: no word of the prose calls for another type (`3D` and the like also occur in its junk).
PROSE_TYPES = TypeWords(plans="(?!)", views="(?!)", trends="(?!)")

CANDIDATE_SCORE = 0.4
CHARS_PER_FIGURE, MAX_FIGURES = 1500, 8
PROMPT_CHARS, PAGE_CHARS = 12_000, 1800
CONTENT_ITEMS = 8
MIN_ANCHOR, ANCHOR_SHARE, MIN_CONFIDENCE, MAX_OVERLAP = 10, 0.7, 0.5, 0.6

# Record tags.
PARA_HEAD, PARA_TEXT, CTRL_HEADER, CTRL_DATA, LIST_HEADER = 0x32, 0x33, 0x36, 0x3A, 0x45
DOC_PROPERTIES, ID_MAPPINGS, COMPATIBLE_DOCUMENT = 0x10, 0x11, 0x1E

# Names of record tags.
TAG_NAMES = {
    0x10: "DOCUMENT_PROPERTIES", 0x11: "ID_MAPPINGS", 0x12: "BIN_DATA", 0x13: "FACE_NAME", 0x14: "BORDER_FILL", 0x15: "CHAR_SHAPE", 0x16: "TAB_DEF",
    0x17: "PARA_NUM_DEF", 0x18: "BULLET_DEF", 0x19: "MEMO_SHAPE", 0x1A: "PARA_SHAPE", 0x1B: "STYLE", 0x1C: "DOC_DATA", 0x1D: "DISTRIBUTE_DOC_DATA",
    0x1E: "COMPATIBLE_DOCUMENT", 0x1F: "LAYOUT_COMPATIBILITY", 0x20: "TRACK_CHANGES", 0x21: "TRACK_CHANGE_AUTHOR", 0x32: "PARA_HEAD", 0x33: "PARA_TEXT",
    0x34: "PARA_CHAR_SHAPE", 0x35: "PARA_LINE_SEG", 0x36: "CTRL_HEADER", 0x37: "PARA_VERTICAL_ALIGN", 0x38: "PARA_HEAD_2", 0x3A: "CTRL_DATA",
    0x3C: "EQEDIT", 0x3E: "SHAPE_COMPONENT_TEXTBOX", 0x3F: "SHAPE_COMPONENT_LINE", 0x40: "SHAPE_COMPONENT_RECT", 0x41: "SHAPE_COMPONENT_ELLIPSE",
    0x42: "SHAPE_COMPONENT_ARC", 0x43: "SHAPE_COMPONENT_POLYGON", 0x44: "SHAPE_COMPONENT_CURVE", 0x45: "LIST_HEADER", 0x46: "PAGE_DEF",
    0x47: "FOOTNOTE_SHAPE", 0x48: "PAGE_BORDER_FILL", 0x49: "SHAPE_COMPONENT", 0x4A: "TABLE", 0x4B: "CELL_LIST_HEADER", 0x4C: "CELL", 0x4D: "ROW",
    0x4F: "NUMBERING", 0x50: "BULLET", 0x57: "TRACK_CHANGE", 0x58: "TRACK_CHANGE_MERGED", 0x59: "MEMO", 0x5A: "MEMO_LIST",
}

# Controls by their four bytes, and those that are known but handled in part only.
CONTROL_NAMES = {
    "secd": "SECTION_DEF", "cold": "COLUMN_DEF", "tbl ": "TABLE", "gso ": "DRAWING", "eqed": "EQUATION", "hdr ": "HEADER", "ftr ": "FOOTER",
    "fn  ": "FOOTNOTE", "en  ": "ENDNOTE", "tc  ": "INDEX_MARK", "fld ": "FIELD", "bokm": "BOOKMARK", "tdut": "HIDDEN_COMMENT", "idot": "MEMO",
    "nwno": "NEW_NUMBER", "pgnp": "PAGE_NUM_POS", "pgct": "PAGE_COUNT", "spbp": "START_NUM", "hyln": "HYPERLINK", "tab ": "TAB", "revt": "REVISION",
    "mequ": "MATH_EQUATION", "head": "SECTION_HEAD",
}
PARTIAL_CONTROLS = ("revt", "mequ", "idot")

# Tags whose counts the second record of the document stream declares, four bytes each, in this order.
DECLARED_TAGS = (0x12, 0x13, 0x14, 0x15, 0x16, 0x17, 0x18, 0x1A)
COLUMNS = (1, 20)
LOOK_AHEAD, DATA_AHEAD = 5, 4
# What a file header starts with, and the names of its flags from the lowest bit on.
FILE_SIGNATURE = "HWP Document File"
FILE_FLAGS = ("compressed", "password", "distributed", "script", "drm", "xml_template", "history", "sign", "cert_encrypt", "ccl", "mobile", "track_changes")
DOC_STREAM, SECTION_STREAM, MASTER_STREAM = "DocInfo", "BodyText/Section", "MasterPage"

# Display classes of lines, in order of precedence.
LINE_CLASSES = (
    (r"^\d+\.\s", "h-num"), (r"^[가나다라마바사아자차]\.\s", "h-kor"), (r"^□", "lv1"), (r"^[○◯◦]", "lv2"), (r"^[❍■▪◈‣·]", "lv3"), (r"^[-–]\s", "dash"),
    (r"^※", "note"), (r"^(붙임|첨부)", "h-attach"),
)
NO_TITLE = r"^[\d가-힣]\s*[.)]"
TITLE_CHARS = 8
HEADING_CHARS = 40
HEADING_START = r"^(\s*(\d+\.|[가-힣]\.|[ⅠⅡⅢⅣⅤ]+\.|[【\[].+[】\]])\s*)\S"
UNITS_PER_MM, UNITS_PER_PIXEL, TEXT_WIDTH = 283.465, 75, 42520

# Lines of plain blocks that become headings and bullets in Markdown.
MARKDOWN_HEADING = r"^(\d+\.\s|[가-힣]\.\s|붙임|【|<)"
MARKDOWN_BULLET = r"^[□◈▪▶●◦❍∘·\-*]\s?"
MARKDOWN_TITLE_CHARS = 6

# Formats by extension, and names of encodings.
FORMATS = ("hwpx", "hwp", "docx", "pdf", "md", "txt")
PREVIEW_FORMATS = ("docx", "doc", "hwpx", "hwp", "pdf")
KOREAN_ENCODINGS = ("ks-c-5601", "ks-c-5601-1987", "cp949")

# Entries that a package must have.
REQUIRED_ENTRIES = ("mimetype", "META-INF/container.xml", "META-INF/manifest.xml", "version.xml", "settings.xml", "Contents/header.xml", "Contents/content.hpf")
STYLE_GROUPS = {"charProperties": "charPr", "paraProperties": "paraPr", "borderFills": "borderFill"}


# Words that tell places for images and their kinds apart.
@dataclass(frozen=True)
class SlotWords:
    marker: str = r"(?i)#\s*그림|그림\s*삽입|이미지\s*삽입|사진\s*삽입|\[?\s*image\s*\]?"
    title: str = "전경도|배치도|조감도|홍보물|안내도|포스터|카드뉴스"
    nearest: str = "붙임|전경도|개요|지원|홍보|행사|기후|음수대|부스"
    nearest_default: str = "보고서 이미지"
    kinds: tuple[tuple[str, str], ...] = (
        ("venue", "전경도|행사장|잠원|한강|배치|지도|location|map"), ("campaign", "qr|홈페이지|홍보|캠페인|실천|대국민"), ("booth", "부스|운영|설치"), ("water", "음수대|수돗물|물탱크|탈플라스틱|water"),
    )
    other: str = "diagram"
    english: str = "[a-zA-Z]{3,}"
    native: str = "[가-힣]"
    sentence: str = "[다했다이다니다습니다]$"


# Labels of kinds of places, kinds shown for them, and kinds shown for types of figures.
SLOT_LABELS = {"venue": "행사장 전경도", "campaign": "기후행동 홍보 이미지", "booth": "홍보부스 운영 이미지", "water": "스마트 음수대 안내 이미지", "diagram": "보고서 설명 다이어그램"}
SLOT_KINDS = {"venue": "지도시각화", "campaign": "홍보물", "booth": "인포그래픽", "water": "인포그래픽", "diagram": "다이어그램", "other": "기타이미지"}
FIGURE_KINDS = {
    "concept_diagram": "다이어그램", "comparison_table": "인포그래픽", "flow_chart": "공정도", "roadmap": "공정도", "map_layout": "지도시각화", "floor_plan": "지도시각화",
    "rendering": "조감도", "bar_chart": "다이어그램", "line_chart": "다이어그램", "photo": "조감도", "cover_banner": "홍보물", "other": "기타이미지",
}
DEFAULT_KIND = "다이어그램"
MAX_SLOTS, SLOT_CHARS, ITEM_CHARS, ANCHOR_CHARS = 12, 46, 25, 20
WIDE_TABLE, HIGH_TABLE, WIDE_CELL, HIGH_CELL = 50_000, 20_000, 25_000, 12_000
PROMPT_PURPOSE = "보고서 내용 시각화"
PROMPT_GUIDE = "공공기관 보고서용, 흰 배경, 명확한 한글 라벨, 16:9 비율, 간결하고 전문적인 스타일"
PROMPT_LABELS = ("이미지 목적", "시각화 요소", "유형", "생성 방향")


# Labels of the parts of a structured request for an image, and the rules that end each request.
@dataclass(frozen=True)
class PromptParts:
    type: str = "유형"
    purpose: str = "이미지 목적"
    content: str = "이미지 내용"
    topic: str = "문서 주제"
    direction: str = "생성 방향"
    rules: tuple[str, ...] = (
        "IMPORTANT: Absolutely NO people, NO human figures, NO portraits, NO faces, NO characters, NO anime, NO realistic humans. Abstract diagram, infographic, or map illustration ONLY.",
        "16:9 landscape ratio. White background. Suitable for embedding in an official Korean public-sector report. No watermark, no extra text artifacts.",
    )


PLACE_TITLE = "AI 추천 위치"

# What a converter's status lines start with.
STATUS_PREFIXES = ("Reading:", "Converting:", "Output:", "Image mode:", "Token efficient:", "Wrote markdown:", "Wrote image manifest:")
