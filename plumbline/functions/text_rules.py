"""Tagging of question text by ordered word rules, as one CASE expression per tag (no UDF)."""

from pyspark.sql import functions as F

# Rule words in order of precedence; the first rule that matches names the intent.
INTENT_RULES = (
    ("correlation", ("correlat", "relationship", "relate", "between")),
    ("trend", ("trend", "over time", "grow", "increas", "decreas", "change")),
    ("distribution", ("distribut", "histogram", "spread", "how[^\\n]*distribut")),
    ("outlier", ("outlier", "anomal", "unusual", "extreme", "weird")),
    ("comparison", ("compare", "vs", "versus", "differ")),
    ("ranking", ("top", "highest", "best", "most", "rank", "leader")),
    ("ranking", ("bottom", "lowest", "worst", "least", "fewest", "weakest")),
    ("schema", ("schema", "column", "field", "what[^\\n]*data", "structure", "describe", "list")),
    ("count", ("count", "how many", "number of", "frequency")),
    ("groupby", ("group[^\\n]*by", "by", "segment", "breakdown", "split", "per", "each")),
    ("measure", ("measure", "calculat", "creat", "add", "make", "build", "dax", "powerbi")),
    ("forecast", ("forecast", "predict", "next", "future", "will")),
    ("summary", ("summary", "overview", "summar", "describe", "stats")),
    ("unique", ("unique", "distinct", "different")),
    ("missing", ("missing", "null", "empty", "blank")),
    ("percent", ("percent", "proportion", "share", "ratio")),
)
AGGREGATION_WORDS = (
    ("average", "mean"), ("avg", "mean"), ("mean", "mean"), ("sum", "sum"), ("total", "sum"),
    ("maximum", "max"), ("max", "max"), ("highest", "max"), ("minimum", "min"), ("min", "min"),
    ("lowest", "min"), ("count", "count"), ("median", "median"), ("std", "std"), ("variance", "var"),
    ("range", "range"),
)
AGGREGATION_WORDS_CLASSIC = (
    ("average", "mean"), ("avg", "mean"), ("mean", "mean"), ("total", "sum"), ("sum", "sum"),
    ("maximum", "max"), ("max", "max"), ("highest", "max"), ("minimum", "min"), ("min", "min"),
    ("lowest", "min"), ("count", "count"), ("how many", "count"), ("median", "median"), ("std", "std"),
    ("standard deviation", "std"),
)
ASCENDING_WORDS = ("bottom", "lowest", "worst", "least", "fewest", "weakest")

# A word character is a letter, a digit or an underscore in any script.
_WORD = r"[\p{L}\p{N}_]"


def whole_words(words, mode="reference"):
    """``reference`` wants a word end after the stem too, so 'correlation' misses 'correlat'; ``stem`` does not."""
    end = rf"(?!{_WORD})" if mode == "reference" else ""
    return rf"(?<!{_WORD})(?:{'|'.join(words)}){end}"


def _mentions(lowered, words):
    """A plain substring search that most texts fail, so that the pattern runs on few of them."""
    found = F.lit(False)
    for word in words:
        pieces = word.split("[^\\n]*")
        test = lowered.contains(pieces[0])
        for piece in pieces[1:]:
            test = test & lowered.contains(piece)
        found = found | test
    return found


def intent(text, mode="reference", lowered=None):
    """The first rule that matches; pass ``lowered`` to share the lower-cased text between tags."""
    lowered = F.lower(text) if lowered is None else lowered
    tag = F.when(text.isNull(), F.lit(None).cast("string"))
    for name, words in INTENT_RULES:
        tag = tag.when(_mentions(lowered, words) & lowered.rlike(whole_words(words, mode)), F.lit(name))
    return tag.when(_mentions(lowered, [word for word, _ in AGGREGATION_WORDS]), F.lit("aggregation")).otherwise(
        F.lit("general"))


def aggregation(text, words=AGGREGATION_WORDS, lowered=None):
    """Name of the first listed word (in list order) that occurs anywhere in the text."""
    lowered = F.lower(text) if lowered is None else lowered
    tag = F.when(text.isNull(), F.lit(None).cast("string"))
    for word, name in words:
        tag = tag.when(lowered.contains(word), F.lit(name))
    return tag


def aggregation_word(text, words=AGGREGATION_WORDS):
    return aggregation(text, tuple((word, word) for word, _ in words))


def top_n(text, default=10, most=None):
    """First stand-alone number in the text, else the default; optionally limited to ``most``."""
    digits = F.regexp_extract(text, rf"(?<!{_WORD})([0-9]+)(?!{_WORD})", 1)
    value = F.when(digits == "", F.lit(default).cast("bigint")).otherwise(
        F.coalesce(digits.try_cast("bigint"), F.lit(2**63 - 1))
    )
    return value if most is None else F.when(digits == "", value).otherwise(F.least(value, F.lit(most)))


def ascending(text, lowered=None):
    return _mentions(F.lower(text) if lowered is None else lowered, ASCENDING_WORDS)
