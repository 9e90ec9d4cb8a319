"""Rule packs: the words and patterns of a language, as data.

Operators take a ``RulePack``; ``NEPALI`` is the pack of Nepali law.  Words,
labels and thresholds below are fixed values: results depend on them exactly.
Patterns are written with explicit classes, so that they mean the same in Java,
Python and RE2.
"""

from __future__ import annotations

from dataclasses import dataclass, field

DIGIT = "[0-9०-९]"


@dataclass(frozen=True)
class RulePack:
    """What the operators need to know of a language of law."""

    # relevance filter: a group counts once, whatever number of its words occur
    keyword_groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    skip_types: tuple[str, ...] = ()
    skip_titles: tuple[str, ...] = ()
    min_score: int = 2
    min_length: int = 20
    # page cleaning
    site: str = ""
    footnote: str = ""
    # structure of an act
    annex: str = ""
    chapter: str = ""
    section: str = ""
    subsection: str = ""
    clause: str = ""
    clause_class: str = ""
    amendment: str = ""
    starts: tuple[str, ...] = ()
    start_contains: tuple[str, ...] = ()
    gazette_words: tuple[str, ...] = ()
    front_lines: int = 20
    proviso: str = ""
    explanation: str = ""
    reference: str = ""
    reference_codes: dict[str, str] = field(default_factory=dict)
    # front matter
    title_word: str = ""
    doc_types: tuple[tuple[str, str], ...] = ()
    date_labels: tuple[tuple[str, str], ...] = ()
    date_value: str = ""
    amendment_stop: tuple[str, ...] = ()
    # labels of composed texts
    labels: dict[str, str] = field(default_factory=dict)
    # entities
    province_words: tuple[str, ...] = ()
    local_words: tuple[str, ...] = ()
    levels: dict[str, str] = field(default_factory=dict)
    currency_before: str = ""
    currency_after: str = ""
    office_rejects: tuple[str, ...] = ()
    document_rejects: tuple[str, ...] = ()
    service_names: tuple[str, ...] = ()
    time_words: tuple[str, ...] = ()
    fee_words: tuple[str, ...] = ()
    penalty_words: tuple[str, ...] = ()
    task_rules: tuple[tuple[str, str], ...] = ()
    default_task: str = ""
    # definition of a term: group 1 is the term
    definition: str = ""


NEPALI = RulePack(
    keyword_groups={
        "office": ("कार्यालय", "विभाग", "मन्त्रालय", "बोर्ड", "निकाय", "रजिष्ट्रार", "अधिकारी", "कमिसन", "प्राधिकरण", "एकल बिन्दु सेवा केन्द्र"),
        "document": (
            "निवेदन", "कागजात", "प्रमाणपत्र", "प्रतिलिपि", "दरखास्त", "फारम", "प्रतिवेदन", "विवरण", "नागरिकता", "अनुमतिपत्र", "इजाजतपत्र",
        ),
        "process": ("दर्ता", "नवीकरण", "खारेज", "नामसारी", "अनुमति", "अनुमती", "स्वीकृति", "सिफारिस", "निर्णय", "आवेदन", "जाँचबुझ"),
        "fee": ("दस्तुर", "शुल्क", "रकम", "रुपैयाँ", "जरिवाना", "विगो", "मूल्य"),
        "duration": ("दिनभित्र", "दिन भित्र", "म्याद", "अवधि", "समयावधि", "महिना", "वर्ष"),
    },
    skip_types=("preamble",),
    skip_titles=("परिभाषा", "संक्षिप्त नाम", "प्रारम्भ"),
    min_score=2,
    min_length=20,
    site=r"www\.lawcommission\.gov\.np",
    footnote=(
        r"(?:लगानी सहजीकरण|आर्थिक तथा व्यावसायिक)[^।]{0,150}सम्[बव]न्धी\s*केही\s*नेपाल\s*ऐनलाई\s*संशोधन\s*गर्न[े]?\s*ऐन\s*,?\s*"
        rf"{DIGIT}{{4}}\s*द्वारा\s*[^।]{{0,20}}।"
    ),
    annex=rf"^अनुसूची\s*[-–]?\s*({DIGIT}*)(?:\s*\(([क-ज्ञ])\))?",
    chapter=rf"^परिच्छेद\s*[-–]?\s*({DIGIT}+)",
    section=rf"^({DIGIT}+)\.\s*(.+?)(?:[:ः]|$)",
    subsection=rf"^\(({DIGIT}+)\)\s*",
    clause=r"^\(([क-ज्ञ])\)\s*",
    clause_class="क-ज्ञ",
    amendment="संशोधन गर्ने ऐन",
    starts=("प्रस्तावना", "परिच्छेद"),
    start_contains=("संक्षिप्त नाम",),
    gazette_words=("सूचना", "आदेश", "निर्देशिका", "विज्ञप्ति", "अधिसूचना", "नियमावली"),
    front_lines=20,
    proviso="तर ",
    explanation="स्पष्टीकरणः",
    reference=rf"(दफा|उपदफा|परिच्छेद|खण्ड)\s+({DIGIT}+|\([0-9०-९क-ज्ञ]+\))",
    reference_codes={"दफा": "sec", "उपदफा": "sub", "परिच्छेद": "ch", "खण्ड": "cl"},
    title_word="ऐन",
    doc_types=(
        ("ऐन", "act"), ("निर्देशिका", "directive"), ("नियमावली", "regulation"), ("विनियमावली", "bylaw"), ("कार्यविधि", "procedure"),
        ("आदेश", "order"), ("नीति", "policy"), ("सन्धि", "treaty"), ("सम्झौता", "agreement"), ("अधिनियम", "statute"), ("संहिता", "code"),
        ("मापदण्ड", "standard"), ("सूचना", "notice"), ("विज्ञप्ति", "communique"), ("अधिसूचना", "notification"),
    ),
    date_labels=(
        (r"स्वीक[ृत]+\s*मिति", "date_commenced"), (r"प्रमाणीकरण\s*मिति", "date_commenced"), (r"प्रकाशित\s*मिति", "date_published"),
    ),
    date_value=rf"({DIGIT}+\s*[।/]\s*{DIGIT}+\s*[।/]\s*{DIGIT}+)",
    amendment_stop=(r"^परिच्छेद", r"प्रमाणीकरण", r"^संवत्"),
    labels={"ch": "परिच्छेद", "sec": "दफा", "sub": "उपदफा", "clause": "खण्ड"},
    province_words=("प्रदेश",),
    local_words=("स्थानीय", "नगरपालिका", "गाउँपालिका"),
    levels={"province": "प्रदेश", "local": "स्थानीय", "centre": "केन्द्र"},
    currency_before=r"रु\.?\s*([0-9०-९,\.]+)",
    currency_after=r"([0-9०-९,\.]+)\s*रुपैयाँ",
    office_rejects=(r"^बमोजिम$", r"^बमोजिम\s", r"सिफारिसमा$", r"^निकायको\s"),
    document_rejects=(
        r"^उपदफा\s*\(.*\)$", rf"^दफा\s*{DIGIT}+", r"^बमोजिम$", r"^मिति$", r"^एक पटक$", r"^प्रतिशत$", r"^सुझाव$", r"^सिफारिस$",
        r"^दस्तुर$", r"^जानकारी$", r"^अभिलेख$", r"^कागजात$",
    ),
    service_names=("उद्योग दर्ता", "नवीकरण", "नामसारी", "नाम परिवर्तन", "स्थानान्तरण", "क्षमता वृद्धि", "पुँजी वृद्धि"),
    time_words=("दिन", "महिना", "वर्ष", "कार्य दिन", "भित्र", "सम्म"),
    fee_words=("रु", "रुपैयाँ", "शुल्क", "दस्तुर", "हजार"),
    penalty_words=("जरिवाना", "जरिबाना", "सजाय"),
    task_rules=(
        (r"दर्ता", "उद्योग दर्ता"), (r"नवीकरण", "उद्योग नवीकरण"), (r"खारेज|विघटन", "उद्योग खारेज"), (r"नामसारी|हस्तान्तरण", "उद्योग नामसारी"),
        (r"अनुमति|इजाजत", "उद्योग अनुमतिपत्र"), (r"विस्तार|क्षमता", "उद्योग विस्तार"), (r"वातावरण", "वातावरणीय अनुमति"),
    ),
    default_task="सामान्य प्रक्रिया",
    definition=r"[\"“]([^\"”]{1,80})[\"”]\s*भन्नाले",
)
