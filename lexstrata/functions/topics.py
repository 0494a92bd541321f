"""Topic rules: kept country names, country mentions, ordered needles, and what a view shows of them.

Comparisons fold A-Z only. Prefixes count characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import ascii_lower, trimmed

INDIA, GEOGRAPHY, STATES, GERMANY, AUSTRALIA, GENERAL = "India", "Geography of India", "United States", "Germany", "Australia", "General"
# The countries that views group by, and other names of the second.
COUNTRIES = (INDIA, STATES, GERMANY, AUSTRALIA)
STATES_NAMES = ("united states", "usa", "us", "united states of america")
# Needles in order, by the label of the first that a text holds.
INDIA_RULES = (
    (
        "Geography of India",
        (
            "states and union territor", "union territor", "states of india", "districts of", "cities in india", "cities and towns in", "populated places in",
            "metropolitan cities", "capitals in india", "municipal corporat", "andhra pradesh", "arunachal", "assam", "bihar", "chhattisgarh", "gujarat", "haryana",
            "himachal", "jharkhand", "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "orissa",
            "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand", "west bengal", "new delhi", "mumbai", "kolkata",
            "chennai", "bengaluru", "bangalore", "hyderabad", "ahmedabad", "pune", "jaipur", "lucknow", "ganges", "yamuna", "brahmaputra", "thar desert",
        ),
    ),
    (
        "History of India",
        (
            "history of india", "ancient india", "medieval india", "british raj", "british india", "company rule", "mughal", "maratha", "independence movement",
            "partition of india", "indian independence",
        ),
    ),
    (
        "Politics of India",
        (
            "politics of india", "political parties in india", "elections in india", "lok sabha", "rajya sabha", "prime minister of india", "government of india",
            "indian national congress", "bharatiya janata", "law of india", "constitution of india", "supreme court of india", "military of india", "indian army",
            "armed forces of india",
        ),
    ),
    (
        "Economy of India",
        (
            "economy of india", "companies of india", "companies based in", "economic history of india", "industry in india", "agriculture in india",
            "transport in india", "indian railways", "airports in india", "highways in india", "ports of india",
        ),
    ),
    (
        "Culture of India",
        (
            "sport in india", "sports in india", "cricket in india", "indian premier league", "hockey in india", "cinema of india", "bollywood", "film in india",
            "indian films", "cuisine of india", "indian cuisine", "languages of india", "indo-aryan languages", "dravidian languages", "religion in india",
            "hinduism in india", "islam in india", "sikhism", "culture of india", "indian literature", "music of india",
        ),
    ),
    (
        "Rivers of India",
        (
            "tributaries of", "rivers of india", "rivers in india", "river systems of", "drainage of india", "ganges", "ganga river", "brahmaputra", "yamuna",
            "godavari", "narmada", "kaveri", "cauvery", "mahanadi", "sutlej", "hooghly",
        ),
    ),
    (
        "Geography of India",
        (
            "mountain ranges of india", "himalay", "climate of india", "monsoon", "geography of india", "indian ocean", "western ghats", "indo-gangetic",
            "national parks of india",
        ),
    ),
    (
        "Science and society in India",
        (
            "education in india", "universities in india", "medicine in india", "health in india", "science and technology in india", "demographics of india",
            "indian people",
        ),
    ),
)
# General subjects, in order.
GENERAL_RULES = (
    ("Mathematics", ("mathematic",)),
    ("Science", ("physics", "chemistry", "biolog", "astronom", "science")),
    ("Technology", ("computer", "software", "technolog", "engineer")),
    ("History", ("history", "war ", "empire")),
    ("Geography", ("geography", "cities", "countries")),
    ("Politics", ("politic", "government", "election")),
    ("Economy", ("econom",)),
    ("Philosophy", ("philosoph",)),
    ("Religion", ("religion",)),
    ("Arts and culture", ("literatur", "music", "film", "art ")),
    ("Sports", ("sport",)),
    ("Biography", ("living people", "births", "people")),
)
# What counts as a mention of a country: substrings, then whole words.
MENTIONS = {
    INDIA: (("india", "bharat"), ()),
    STATES: (("united states", "u.s.a", "u.s."), ("usa",)),
    GERMANY: (("germany", "deutschland"), ("german", "germans")),
    AUSTRALIA: (("australia",), ()),
}
HEAD = 4000


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def contains_word(low: Column, word: str) -> Column:
    """Whether folded text holds ``word`` with no letter or digit at either side; matches are looked for one after another."""
    edge = r"(?<![a-z0-9])\Q" + word + r"\E(?![a-z0-9])"
    return low.rlike(edge) if word else F.lit(False)


def _array(values: list[str]) -> Column:
    return F.expr("array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")")


def first_label(text: Column, rules: tuple) -> Column:
    """Label of the first needle in order that the folded text holds, or ''."""
    low = ascii_lower(_given(text))
    flat = [(label, needle) for label, needles in rules for needle in needles]
    needles = _array([n for _, n in flat])
    first = F.get(F.filter(needles, lambda n: F.contains(low, n)), F.lit(0))
    return F.coalesce(F.get(_array([x for x, _ in flat]), (F.array_position(needles, first) - 1).cast("int")), F.lit(""))


def mentions(low: Column, country: str) -> Column:
    parts, words = MENTIONS[country]
    found = F.lit(False)
    for x in parts:
        found = found | low.contains(x)
    for w in words:
        found = found | contains_word(low, w)
    return found


def _settled(c: Column) -> Column:
    """``c``, worked out where it stands: filters on it aren't rewritten into filters on all that it is made of."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def _kept(low: Column) -> Column:
    out = F.when(low == "india", INDIA).when(low == "geography of india", GEOGRAPHY).when(low.isin(*STATES_NAMES), STATES)
    return out.when(low == "germany", GERMANY).when(low == "australia", AUSTRALIA).otherwise("")


def kept_topic(topic: Column) -> Column:
    """The shared name of a country (or of the geography topic) if the topic is one of its names, else ''."""
    return _kept(ascii_lower(trimmed(_given(topic))))


#: Countries that mentions decide on.
MENTIONED = (STATES, GERMANY, AUSTRALIA)


def _only(flags: dict[str, Column]) -> Column:
    """The country whose flag alone is set, or null."""
    out = None
    for c in MENTIONED:
        others = [flags[o] for o in MENTIONED if o != c]
        alone = flags[c] & ~others[0] & ~others[1]
        out = F.when(alone, c) if out is None else out.when(alone, c)
    return out


def with_country(df: DataFrame, title: str, text: str, out: str) -> DataFrame:
    """Adds ``out``: United States, Germany or Australia if the title names it, alone mentions it, or title and text's head do; else ''."""
    n, x = _given(F.col(title)), F.substring(_given(F.col(text)), 1, HEAD)
    step = df.select("*", ascii_lower(trimmed(n)).alias("_ln"), ascii_lower(n).alias("_low"), ascii_lower(F.concat(n, F.lit(" | "), x)).alias("_blob"))
    flags = [mentions(F.col(c), k).alias(f"{c}{i}") for c in ("_low", "_blob") for i, k in enumerate(MENTIONED)]
    step = step.select("*", _kept(F.col("_ln")).alias("_kn"), *flags)
    in_title, found = ({k: F.col(f"{c}{i}") for i, k in enumerate(MENTIONED)} for c in ("_low", "_blob"))
    named = F.when(F.col("_kn").isin(*MENTIONED), F.col("_kn"))
    return step.select(*df.columns, _settled(F.coalesce(named, _only(in_title), _only(found), F.lit(""))).alias(out))


def with_india(df: DataFrame, title: str, text: str, out: str) -> DataFrame:
    """Adds ``out``: the geography topic, India, or '', from the title and the text's head."""
    blob = F.concat(_given(F.col(title)), F.lit(" | "), F.substring(_given(F.col(text)), 1, HEAD))
    step = df.select("*", blob.alias("_blob")).select("*", first_label(F.col("_blob"), INDIA_RULES).alias("_label"))
    found = F.when(F.col("_label") == GEOGRAPHY, GEOGRAPHY).when((F.col("_label") != "") | mentions(ascii_lower(F.col("_blob")), INDIA), INDIA).otherwise("")
    return step.select(*df.columns, _settled(found).alias(out))


def with_canonical(df: DataFrame, topic: str, title: str, out: str) -> DataFrame:
    """Adds (or replaces) ``out``: a kept name of topic or title, a country by mentions, India by the rules, else the topic, else General.

    Steps are columns of their own, so that no rule is worked out twice.
    """
    step = with_country(df.select("*", F.concat(_given(F.col(title)), F.lit(" | "), _given(F.col(topic))).alias("_both")), title, topic, "_country")
    step = step.select("*", first_label(F.col("_both"), INDIA_RULES).alias("_label"), trimmed(_given(F.col(topic))).alias("_own"), kept_topic(F.col(topic)).alias("_kt"), kept_topic(F.col(title)).alias("_kn"))
    found = [F.nullif(F.col(c), F.lit("")) for c in ("_kt", "_kn", "_country")]
    mapped = F.when(F.col("_label") == GEOGRAPHY, GEOGRAPHY).when(F.col("_label") != "", INDIA)
    canonical = F.coalesce(*found, mapped, F.nullif(F.col("_own"), F.lit("")), F.lit(GENERAL))
    return step.select(*(c for c in df.columns if c != out), _settled(canonical).alias(out))


def shown(topic: Column) -> Column:
    """The topic with the geography topic shown as India."""
    return F.when(ascii_lower(trimmed(topic)) == "geography of india", INDIA).otherwise(topic)


def is_country(topic: Column) -> Column:
    return ascii_lower(trimmed(shown(_given(topic)))).isin(*(c.lower() for c in COUNTRIES))


def pretty(topic: Column) -> Column:
    """A subject as shown: '_' as blanks, words capitalised; '' for countries and for general."""
    t = trimmed(_given(topic))
    low = ascii_lower(t)
    # The first letter of each word, wherever it stands in it, is upper; the mark splits a word there.
    marked = F.transform(F.split(F.translate(t, "_", " "), " "), lambda w: F.split(F.regexp_replace(w, "^([^A-Za-z]*)", "$1\0"), "\0"))
    capital = F.array_join(F.transform(marked, lambda p: F.concat(p[0], F.upper(F.substring(p[1], 1, 1)), F.substring(p[1], 2, 1 << 30))), " ")
    return F.when((t == "") | is_country(t) | (low == "general"), "").when(low == "computer_science", "Computer science").otherwise(capital)


def with_view_topics(df: DataFrame, wiki: Column | None = None) -> DataFrame:
    """``df`` (topic, title) with the topic of a view, one of COUNTRIES or '', and subtopic: the stored topic as a subject.

    Where a country shows, the subtopic is empty if the stored topic names it or, as ``wiki`` says, the page is an article
    of the encyclopedia, whose topics are canonical first.
    """
    step = with_canonical(df.drop("subtopic"), "topic", "title", "_canonical")
    step = step.select("*", shown(F.col("_canonical")).alias("_display"), pretty(F.col("topic")).alias("_pretty"), F.coalesce(wiki if wiki is not None else F.lit(False), F.lit(False)).alias("_wiki"))
    step = step.select("*", is_country(F.col("_display")).alias("_is"))
    subtopic = F.when(F.col("_is") & F.col("_wiki"), "").otherwise(F.col("_pretty"))
    topic = F.when(F.col("_is"), F.col("_display")).otherwise("")
    return step.select(*(c for c in df.columns if c not in ("topic", "subtopic")), _settled(topic).alias("topic"), _settled(subtopic).alias("subtopic"))


def needle(spark: SparkSession, wanted: str) -> str:
    """The folded topic that a view's parameter asks for."""
    row = with_canonical(spark.createDataFrame([(wanted.strip(), wanted.strip())], "topic string, title string"), "topic", "title", "c")
    return row.select(ascii_lower(shown(F.col("c")))).first()[0]


def matches(topic: Column, asked: str) -> Column:
    """Whether a view's topic is the one asked for; documents of no country are all General."""
    return F.when(topic == "", F.lit(asked == GENERAL.lower())).otherwise(ascii_lower(topic) == asked)


def is_encyclopedia_name(name: Column) -> Column:
    return ascii_lower(trimmed(_given(name))).isin("wikipedia", "wikipedia india", "wikipedia sample")


def news_topics(locations: Column, codes: Column) -> Column:
    """The countries that a news row's location names or codes hold, in the order of COUNTRIES."""
    loc, v2 = _given(locations), _given(codes)
    india = v2.contains("#IN#IN") | v2.contains("#India#IN#") | F.exists(F.split(loc, ";"), lambda s: (trimmed(s) == "India") | trimmed(s).endswith(", India"))
    states = v2.contains("#US#") | loc.contains("United States")
    germany = v2.contains("#GM#") | loc.contains("Germany")
    australia = loc.contains("Australia") | v2.contains("Australia#AS#") | v2.contains("#AS#AS")
    hit = zip(COUNTRIES, (india, states, germany, australia))
    return F.filter(F.array(*(F.when(h, c) for c, h in hit)), lambda x: x.isNotNull())


def with_accepted(df: DataFrame, title: str, text: str, campaign: str, out: str) -> DataFrame:
    """Adds (or replaces) ``out``: the country under which a page is stored, by its words, else by its campaign; null if neither is one of COUNTRIES."""
    step = with_india(with_country(df, title, text, "_by_words"), title, text, "_india").select("*", kept_topic(F.col(campaign)).alias("_asked"))
    asked = F.when(F.col("_asked") == GEOGRAPHY, INDIA).otherwise(F.nullif(F.col("_asked"), F.lit("")))
    found = F.coalesce(F.nullif(F.col("_by_words"), F.lit("")), F.when(F.col("_india") != "", INDIA), asked)
    return step.select(*(c for c in df.columns if c != out), _settled(found).alias(out))
