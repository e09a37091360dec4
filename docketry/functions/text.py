"""Text as column expressions: normalisation, redaction, screening, clean-up, numbers in text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Redaction patterns in the order in which they are applied, and what takes their place.
REDACTIONS = (
    (r"\b\d{6}-\d{2}-\d{4}\b", "[IC_REDACTED]"),
    (r"\b\d{12}\b", "[IC_REDACTED]"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL_REDACTED]"),
    (r"\b(?:\+?60|0)\d[\d\s-]{6,10}\d\b", "[PHONE_REDACTED]"),
    (r"(?i)\bRM\s?\d[\d,]*(?:\.\d+)?\b", "[AMOUNT_REDACTED]"),
    (r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b", "[AMOUNT_REDACTED]"),
)

# The denylist, categories in the order in which they are reported.
DENYLIST = (
    ("ADV-01", r"ignore\s+(all|any|your|the|previous).{0,25}(instruction|rule|prompt|guardrail)"),
    ("ADV-01", r"forget\s+(your|all|the|any|previous).{0,25}(rule|instruction|prompt)"),
    ("ADV-01", r"\bdeveloper\s+mode\b"),
    ("ADV-01", r"\byou\s+are\s+now\b"),
    ("ADV-01", r"disregard\s+(all|any|your|the|previous)"),
    ("ADV-02", r"\bsystem\s+prompt\b"),
    ("ADV-02", r"\b(initial|original)\s+instructions\b"),
    ("ADV-02", r"reveal\s+your\s+(prompt|instruction|rule|config|setup)"),
    ("ADV-02", r"what\s+(model|llm|ai)\s+are\s+you"),
    ("ADV-02", r"what\s+are\s+your\s+(guardrail|rule|instruction|constraint)"),
    ("ADV-03", r"pretend\s+(you|to\s+be|that)"),
    ("ADV-03", r"\brole\s?play\b"),
    ("ADV-03", r"\bact\s+as\s+(a|an|the)?\s*(senior|credit|bank|admin|approv)"),
    ("ADV-03", r"hypothetical(ly)?.{0,30}approv"),
    ("ADV-04", r"what\s+(numbers|values|figures|amounts).{0,30}(enter|input|put|say).{0,25}approv"),
    ("ADV-04", r"so\s+(i|we)\s+get\s+approved"),
    ("ADV-04", r"how\s+(to|do\s+i|can\s+i)\s+(fake|game|trick|manipulat)"),
    ("ADV-05", r"exact.{0,25}(cut[\s-]?off|threshold|limit|dsr|dscr|score)"),
    ("ADV-05", r"\bstay\s+under\b"),
    ("ADV-05", r"what('?s|\s+is)\s+the\s+(exact\s+)?(cut[\s-]?off|threshold|dsr|dscr)"),
    ("ADV-06", r"(status|application|data|details)\s+(for|of)\s+.{0,40}\b(sdn\s*bhd|bhd|enterprise|trading)\b"),
    ("ADV-06", r"another\s+(customer|applicant|user|person)'?s?"),
    ("ADV-06", r"someone\s+else'?s?\s+(application|data|account)"),
    ("ADV-07", r"(list|dump|show|export|give\s+me)\s+(me\s+)?(all|every)\b.{0,30}(application|record|customer|user|data)"),
    ("ADV-07", r"all\s+(pending|the)\s+applications"),
    ("ADV-07", r"\b(your|the)\s+(entire\s+)?database\b"),
    ("ADV-08", r"\bbase\s?64\b"),
    ("ADV-08", r"decode\s+(this|the\s+following)"),
    ("ADV-08", r"[A-Za-z0-9+/]{24,}={0,2}"),
)

# The steps that take markup out of a sentence, in order.
PROSE_STEPS = (
    (r"^\s+|\s+$", ""),
    (r"^['‘’]+\s*", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"\*\*|`", ""),
    (r"#{1,6}\s*", ""),
    (r":?-{3,}:?", " "),
    (r"\s*\|\s*", ", "),
    (r"(^|\s)[•·*]\s+", "$1"),
    (r"(?:,\s*){2,}", ", "),
    (r"^[\s,;]+", ""),
    (r"\s{2,}", " "),
    (r"^\s+|\s+$", ""),
)

# Words that a cell holds when it holds nothing, after folding.
BLANKS = ("", "na", "n a", "nil", "none", "null", "-", "--", "notavailable", "not available", "notapplicable", "not applicable", "tiada")

# Spellings of name particles.
NAME_ALIASES = {"MOHD": "MOHAMMAD", "MOHAMAD": "MOHAMMAD", "MUHAMMAD": "MOHAMMAD", "MUHD": "MOHAMMAD", "MD": "MOHAMMAD", "BT": "BINTI", "ABD": "ABDUL"}

# headings' keywords, the first section with a hit wins.
SECTIONS = (
    ("overview", ("hire purchase", "government guarantee scheme", "skim jaminan", "program untuk dealer", "commercial financing solutions", "objective", "focus sector")),
    ("financing_size", ("financing size", "financing amount", "financing limit")),
    ("financing_rate", ("financing rate", "profit rate", "indicative installment", "installment amount")),
    ("margin", ("margin of financing", "margin financing")),
    ("tenure", ("tenure", "term of utilisation", "term / revolving")),
    ("guarantee", ("guarantee cover", "guarantee coverage", "guarantee fee", "guarantee per customer")),
    ("eligibility", ("eligibility", "who is eligible", "sme criteria", "eligible dealers", "classification of motor vehicle", "type of motor vehicle")),
    ("purpose", ("purpose of financing", "purpose")),
    ("documents", ("what do we need", "what we need", "required documents")),
    ("fees", ("stamp duty", "fee")),
    ("facility", ("facilit", "application type", "trade facility", "mcash", "floor stocking", "security", "how to enjoy", "campaign")),
    ("contact", ("contact us", "sales management team")),
    ("criteria", ("filtering", "key areas", "key indicators", "no of years", "no of staff", "pd rating", "permitted business", "gearing", "good conduct", "credit record")),
)

# Wording of a question for search.
REWRITES = ((r"(?i)\binterest rate\b", "profit rate"), (r"(?i)\binterest\b", "profit rate"), (r"(?i)\bloans?\b", "financing"), (r"(?i)\bborrow\b", "finance"))

NUMBER = r"\d[\d,]*(?:\.\d+)?"


def chained(col: Column, steps: Sequence[tuple[str, str]]) -> Column:
    for pattern, put in steps:
        col = F.regexp_replace(col, pattern, put)
    return col


def redact(col: Column) -> Column:
    """Identity numbers, mail addresses, phone numbers and amounts replaced; the order matters. Letters and digits of any script bound words."""
    return chained(col, [("(?U)" + p, put) for p, put in REDACTIONS])


def denied(col: Column, patterns: Sequence[tuple[str, str]] = DENYLIST) -> Column:
    """The first category with a hit; null for none, null and empty."""
    return F.coalesce(*[F.when(col.rlike("(?i)" + p), category) for category, p in patterns])


def collapsed(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def normal_id(col: Column) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(col), r"[^\p{L}\p{N}]", "")


def normal_name(col: Column) -> Column:
    """A person's name: upper case, single spaces, particles in one spelling."""
    words = F.split(collapsed(F.upper(col)), " ")
    alias = F.create_map(*[F.lit(x) for pair in NAME_ALIASES.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(alias[w], w)), " ")


def normal_entity(col: Column) -> Column:
    """An entity's name: upper case, single spaces, no punctuation."""
    return collapsed(F.upper(F.regexp_replace(col, r"[^\p{L}\p{N}\s]", "")))


def normal_program(col: Column) -> Column:
    """A program's code: letters only, upper case, a last I dropped."""
    return F.regexp_replace(F.regexp_replace(F.upper(col), "[^A-Z]", ""), "I$", "")


def is_blank(col: Column) -> Column:
    """Null, empty, or a way of saying that nothing is there."""
    folded = F.regexp_replace(collapsed(F.lower(col)), r"[^\p{L}\p{N} -]", "")
    return col.isNull() | folded.isin(*BLANKS)


def clean_prose(col: Column) -> Column:
    """Markup out of a sentence, wording left as it is."""
    return chained(col, PROSE_STEPS)


def canonical_section(heading: Column, sections=SECTIONS) -> Column:
    """The first section whose keywords the heading holds; overview without a heading, other without a hit."""
    low = F.lower(heading)
    found = F.lit("other")
    for name, words in reversed(sections):
        hit = F.lit(False)
        for w in words:
            hit |= F.contains(low, F.lit(w))
        found = F.when(hit, name).otherwise(found)
    return F.when(heading.isNull() | (heading == ""), "overview").otherwise(found)


# Fixed value: the row of dashes under a table's heads.
SEPARATOR = r"(?m)^\s*\|?[\s:|-]*-{3,}[\s:|-]*\|"


def looks_tabular(col: Column) -> Column:
    """Whether a text holds the row of dashes under a table's heads; null is no table."""
    return F.coalesce(col.rlike(SEPARATOR), F.lit(False))


def has_table(col: Column) -> Column:
    """At least two lines that begin and end with a pipe."""
    return F.regexp_count(col, F.lit(r"(?m)^[ \t]*\|[^\n]*\|[ \t]*$")) >= 2


def breadcrumb(label: Column, titles: Column) -> Column:
    """A chunk's trail: its label, then the titles of its sections."""
    return F.concat(label, F.lit(" › "), F.array_join(titles, "; "), F.lit(" › "))


def approx_tokens(col: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col) / 4)).cast("int")


def numbers(col: Column) -> Column:
    """Distinct numbers of a text in order, thousands commas removed."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(col, F.lit(NUMBER), 0), lambda x: F.replace(x, F.lit(","), F.lit("")))))


def highlighted(col: Column) -> Column:
    return F.regexp_replace(col, f"({NUMBER})", "<mark>$1</mark>")


def printed_number(col: Column) -> Column:
    """RM and commas allowed, parentheses negative; null for anything else."""
    bare = F.regexp_replace(F.trim(col), r"(?i)^(\()?\s*RM\s*", "$1")
    negative = bare.rlike(r"^\(.*\)$")
    digits = F.regexp_replace(bare, r"[(),\s]", "")
    value = F.when(digits.rlike(r"^-?\d+(\.\d+)?$"), digits.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def first_number(col: Column) -> Column:
    return F.nullif(F.replace(F.regexp_extract(col, r"-?\d[\d,]*(?:\.\d+)?", 0), F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def rewritten(col: Column) -> Column:
    return chained(col, REWRITES)


def lead_sentence(col: Column, limit: int = 220) -> Column:
    """Without the breadcrumb: up to the first sentence's end, or `limit` characters and an ellipsis."""
    body = F.trim(F.regexp_replace(F.element_at(F.split(col, " › "), -1), "\n", " "))
    sentence = F.regexp_extract(body, r"^(.+?[.!?])(\s|$)", 1)
    lead = F.when(sentence != "", sentence).otherwise(body)
    return F.when(F.length(lead) > limit, F.concat(F.rtrim(F.substring(lead, 1, limit)), F.lit("…"))).otherwise(lead)


def chunk_id(doc: Column, version: Column, section: Column, content: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", doc, version, section, content), 256)
    return F.concat_ws(":", doc, version, F.substring(digest, 1, 16))


def deep_link(uri: Column, pages: Column) -> Column:
    return F.when(F.size(pages) > 0, F.concat(uri, F.lit("#page="), F.array_min(pages).cast("string"))).otherwise(uri)


def page_of(link: Column) -> Column:
    """The page that a link names, else null."""
    return F.regexp_extract(link, r"#page=(\d+)", 1).try_cast("int")


def redacted(col: Column, kind: T.DataType) -> Column:
    """A value of any type with all strings in it redacted; nulls and map keys stay."""
    if isinstance(kind, T.StringType):
        return redact(col)
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*(redacted(col[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: redacted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(col, lambda _, v: redacted(v, kind.valueType))
    return col


def summary_of(items: Column, most: int = 5, n: Column | None = None) -> Column:
    """The first items, then how many more there are: of n, where `items` are the first ones only."""
    named = F.array_join(F.slice(items, 1, most), ", ")
    more = (F.size(items) if n is None else n) - most
    return F.when(more > 0, F.concat(named, F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(named)
