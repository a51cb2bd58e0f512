"""Text expressions: all are built-in column functions, evaluated inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and phrases that decide results.
STOP_WORDS = (
    "a an and are as at be but by do for from had has have he her his how i if in into is it its me my no not "
    "of on or our she so that the their them then there these they this to us was we were what when where which "
    "who will with would you your"
).split()
TEMPORAL_WORDS = "yesterday today recent latest last newest just ago currently now earlier previously".split()
UPDATE_WORDS = "current currently now latest updated changed new moved switched replaced nowadays".split()
PREFERENCE_WORDS = "recommend recommendation recommendations suggest suggestion suggestions advice advise tips tip".split()
PREFERENCE_MARKERS = [
    "i like", "i love", "i hate", "i dislike", "i prefer", "i enjoy", "i don't like", "i dont like", "my favorite",
    "my favourite", "i always", "i usually", "i never", "i tend to", "i use", "i'm using", "i own", "my ",
]
TRIM_SET = "?.,!\"'()[]{}:;"
CHANGE_CUES = (
    r"(?i)\b(switched (from|to)|now use[sd]?|no longer|instead of|replaced|moved to|migrated to|updated to|deprecated|superseded|"
    r"(moved|migrated|switched|changed)\b[^.!?]{0,60}\bfrom\b[^.!?]{0,60}\bto\b)"
)
AI_ROLES = "assistant ai bot model system narrator".split()


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def bind(value: Column, use) -> Column:
    """use(value) with the value worked out once; a plain column inside a lambda is worked out per element."""
    return F.transform(F.array(value), use)[0]


def est_tokens(text: Column) -> Column:
    """A quarter of the bytes, and 20 of overhead."""
    return F.floor(F.octet_length(text) / 4).cast("int") + 20


def fields(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def words(text: Column, least: int = 1) -> Column:
    """Runs of at least ``least`` of [a-z0-9], lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{%d,}" % least), F.lit(0))


def query_terms(text: Column) -> Column:
    """Lower-cased fields that are no stop words, punctuation kept."""
    return F.filter(F.transform(fields(text), F.lower), lambda w: ~w.isin(STOP_WORDS))


def trimmed(word: Column) -> Column:
    return F.btrim(word, F.lit(TRIM_SET))


def content_terms(text: Column) -> Column:
    """Query terms without surrounding punctuation, of more than two bytes."""
    low = F.transform(fields(F.lower(text)), trimmed)
    return F.filter(low, lambda w: (F.octet_length(w) > 2) & ~w.isin(STOP_WORDS))


def share(hits: Column, terms: Column) -> Column:
    """hits / number of terms; 0 without terms."""
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(F.lit(0.0))


def term_overlap(terms: Column, content: Column) -> Column:
    """Share of terms that are substrings of the lower-cased content."""
    return bind(F.lower(content), lambda low: bind(terms, lambda ts: share(F.size(F.filter(ts, lambda t: F.contains(low, t))), ts)))


def graded_relevance(query: Column, content: Column) -> Column:
    """Share of the query's content terms matched by a word, or by a word's first four characters; 0.5 without terms.

    Terms with Han, kana or hangul match if a run of two or more such characters stands in the content.
    """
    terms = F.filter(F.transform(fields(query), lambda w: F.btrim(F.lower(w), F.lit(TRIM_SET + "，。？！"))), lambda w: (w != "") & ~w.isin(STOP_WORDS))

    def matched(t: Column, x: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(CJK_RUN), F.lit(0))
        ascii_hit = F.array_contains(x["own"], t) | ((F.octet_length(t) >= 4) & F.exists(x["own"], lambda w: F.startswith(w, F.left(t, F.lit(4)))))
        return F.when(F.size(runs) > 0, F.exists(runs, lambda r: (F.length(r) >= 2) & F.contains(x["low"], r))).otherwise(ascii_hit)

    known = F.struct(F.lower(content).alias("low"), F.array_distinct(words(content, 2)).alias("own"), terms.alias("terms"))
    return bind(known, lambda x: F.when(F.size(x["terms"]) > 0, F.size(F.filter(x["terms"], lambda t: matched(t, x))) / F.size(x["terms"])).otherwise(F.lit(0.5)))


CJK_RUN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+"


def cjk_bigrams(text: Column) -> Column:
    """Overlapping pairs of every run of CJK characters (a run of one gives itself)."""
    runs = F.regexp_extract_all(text, F.lit(CJK_RUN), F.lit(0))
    pairs = F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.flatten(pairs)


def cjk_share(text: Column) -> Column:
    """Share of CJK characters among letters; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    cjk = F.length(F.regexp_replace(text, CJK_RUN.replace("[", "[^", 1).removesuffix("+"), ""))
    return F.when(letters > 0, cjk / letters).otherwise(F.lit(0.0))


def speaker_lines(content: Column) -> Column:
    """array<struct<speaker, speech>> of lines 'Speaker: text' with a prefix of 1 to 24 of [A-Za-z0-9_ ]."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.trim(x))
    said = F.filter(lines, lambda x: F.rlike(x, F.lit(r"^[A-Za-z0-9_ ]{1,24}: ")))
    return F.transform(said, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z0-9_ ]{1,24}?): ", 1).alias("speaker"), F.regexp_extract(x, r"(?s)^[A-Za-z0-9_ ]{1,24}?: (.*)$", 1).alias("speech")))


def user_overlap(terms: Column, content: Column) -> Column:
    """Share of terms that stand in what speakers say."""
    speech = F.lower(F.array_join(F.transform(speaker_lines(content), lambda x: x["speech"]), " "))
    return bind(speech, lambda said: bind(terms, lambda ts: share(F.size(F.filter(ts, lambda t: F.contains(said, t))), ts)))


def query_names(query: Column) -> Column:
    """Capitalised words of three bytes or more that do not come first, lower-cased, once each."""
    rest = F.transform(F.slice(F.concat(F.array(F.lit("")), fields(query)), F.lit(3), F.greatest(F.size(fields(query)), F.lit(1))), trimmed)
    named = F.filter(rest, lambda w: (F.octet_length(w) >= 3) & F.rlike(w, F.lit("^[A-Z]")))
    return F.array_distinct(F.filter(F.transform(named, F.lower), lambda w: ~w.isin(STOP_WORDS)))


def person_mention(names: Column, content: Column) -> Column:
    """Share of speaker lines whose speaker holds one of the names."""

    def among(lines: Column) -> Column:
        hit = F.filter(lines, lambda x: F.exists(names, lambda n: F.contains(F.lower(x["speaker"]), n)))
        return F.when((F.size(names) > 0) & (F.size(lines) > 0), F.size(hit) / F.size(lines)).otherwise(F.lit(0.0))

    return bind(speaker_lines(content), among)


def preference_score(content: Column) -> Column:
    """Number of preference markers in the content over 5, at most 1."""
    def hits(low: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.contains(low, F.lit(m)).cast("int") for m in PREFERENCE_MARKERS])

    return F.least(bind(F.lower(content), hits) / F.lit(5.0), F.lit(1.0))


def has_word(text: Column, values: list[str], trim: str = "") -> Column:
    """Whether a lower-cased field, less the trimmed characters, is one of the values."""
    low = F.transform(fields(text), lambda w: F.btrim(F.lower(w), F.lit(trim)) if trim else F.lower(w))
    return F.arrays_overlap(low, strings(values))


def is_temporal(query: Column) -> Column:
    return has_word(query, TEMPORAL_WORDS)


def is_update(query: Column) -> Column:
    return has_word(query, UPDATE_WORDS)


def wants_preference(query: Column) -> Column:
    return has_word(query, PREFERENCE_WORDS, "?.,!\"'")


def temporal_window(query: Column) -> Column:
    """struct<from_hours, to_hours> before now that a relative time phrase names, or null."""
    def span(a: int, b: int) -> Column:
        return F.struct(F.lit(a).alias("from_hours"), F.lit(b).alias("to_hours"))

    return (
        F.when(query.rlike(r"(?i)\byesterday\b"), span(48, 12))
        .when(query.rlike(r"(?i)\blast week\b|\ba week ago\b|\bpast week\b"), span(288, 96))
        .when(query.rlike(r"(?i)\blast month\b|\ba month ago\b|\bpast month\b"), span(1080, 432))
        .when(query.rlike(r"(?i)\btoday\b|\bthis morning\b|\btonight\b"), span(24, 0))
        .when(query.rlike(r"(?i)\bthis week\b"), span(168, 0))
    )


def decompose(query: Column) -> Column:
    """Two sub-queries of a compound question (conjunction, clause, 'both', two question words), or null."""
    low = F.lower(query)
    n = F.octet_length(query)

    def conjunction(sep: str) -> Column:
        at = F.instr(low, sep) - 1
        a = F.trim(F.substring(query, F.lit(1), at))
        b = F.trim(F.substring(query, at + len(sep) + 1, n))
        ok = (at > 10) & (at < n - 10) & (F.octet_length(a) > 15) & (F.octet_length(b) > 15)
        return F.when(ok, F.array(a, b))

    comma = F.instr(query, ", ") - 1
    after = F.trim(F.substring(query, comma + 3, n))
    after = F.when(F.startswith(F.lower(after), F.lit("and ")), F.trim(F.substring(after, F.lit(5), n))).otherwise(after)
    clause = F.when((comma > 15) & (comma < n - 15) & (F.octet_length(after) > 15), F.array(F.trim(F.substring(query, F.lit(1), comma)), after))
    rest = F.substring(query, F.lit(6), n)
    at = F.instr(F.lower(rest), " and ") - 1
    both = F.when(F.startswith(low, F.lit("both ")) & (at > 10) & (at < F.octet_length(rest) - 10), F.array(F.trim(F.substring(rest, F.lit(1), at)), F.trim(F.substring(rest, at + 6, n))))
    cut = F.regexp_extract_all(query, F.lit(r"(?i)(?:(?<=^)|(?<=[ ,]))(?:who|what|where|when|how|which|why) "), F.lit(0))
    first = F.instr(low, F.lower(cut[0])) - 1
    second = F.call_function("locate", F.lower(cut[1]), low, first + 2) - 1
    p1 = F.rtrim(F.trim(F.substring(query, first + 1, second - first)), F.lit(",;"))
    p2 = F.trim(F.substring(query, second + 1, n))
    asks = F.when((F.size(cut) >= 2) & (F.octet_length(p1) > 15) & (F.octet_length(p2) > 15), F.array(p1, p2))
    return F.coalesce(conjunction(" and "), conjunction(" also "), conjunction(" as well as "), clause, both, asks)


def distinctive_tokens(content: Column) -> Column:
    """Lower-cased runs of four or more letters (below the CJK blocks) or digits, and CJK bigrams, once each."""
    latin = F.filter(F.regexp_extract_all(F.lower(content), F.lit(r"[\p{L}\p{Nd}&&[^\x{2E80}-\x{10FFFF}]]+"), F.lit(0)), lambda w: F.length(w) >= 4)
    return F.array_distinct(F.concat(latin, cjk_bigrams(content)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def slug(text: Column) -> Column:
    """Lower-case words joined by hyphens."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def truncate(text: Column, n: int) -> Column:
    """The first n characters and '...' if there are more."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def flexible_epoch(text: Column) -> Column:
    """Seconds since 1970 of an RFC 3339 time, one without zone (taken as UTC; T or a blank) or a date; else null."""
    day, clock = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}"
    whole = (
        F.when(F.rlike(text, F.lit(f"^{day}$")), F.concat(text, F.lit("T00:00:00Z")))
        .when(F.rlike(text, F.lit(f"^{day}[T ]{clock}$")), F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z")))
        .when(F.rlike(text, F.lit(rf"^{day}T{clock}(\.\d+)?(Z|[+-]\d{{2}}:\d{{2}})$")), F.regexp_replace(text, r"\.\d+", ""))
    )
    return F.unix_seconds(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def cjk_query_term(term: Column) -> Column:
    """A term without CJK as it is; else its parts and bigrams, quoted as a phrase if there are several."""
    parts = F.regexp_extract_all(term, F.lit(CJK_RUN + "|" + CJK_RUN.replace("[", "[^", 1)), F.lit(0))
    split = F.transform(parts, lambda x: F.when(F.rlike(x, F.lit(CJK_RUN)), F.array_join(cjk_bigrams(x), " ")).otherwise(x))
    phrase = F.array_join(split, " ")
    return F.when(~F.rlike(term, F.lit(CJK_RUN)), term).when(F.contains(phrase, F.lit(" ")), F.concat(F.lit('"'), phrase, F.lit('"'))).otherwise(phrase)


# Capitalised words that are no names.
NO_NAMES = (
    "What Where When Who Why How Is Are Was Were Do Does Did Would Could Should Will Can May Has Have Had The A An And Or But If In On At To For Of With "
    "About From Which That This These Those It He She They We I Yes No Not"
).split()


def proper_nouns(query: Column) -> Column:
    """Distinct capitalised words of two letters or more, without possessive endings."""
    found = F.regexp_extract_all(query, F.lit("[A-Za-z0-9']+"), F.lit(0))
    named = F.filter(found, lambda w: F.rlike(w, F.lit("^[A-Z].")) & ~w.isin(NO_NAMES))
    return F.array_distinct(F.filter(F.transform(named, lambda w: F.regexp_replace(w, "'[sS]$", "")), lambda w: F.length(w) > 1))


def name_matches(content: Column, names: Column) -> Column:
    """How many of the names stand in the content between characters other than ASCII letters (case counts)."""
    return F.size(F.filter(names, lambda n: F.regexp_like(content, F.concat(F.lit("(^|[^A-Za-z])"), n, F.lit("($|[^A-Za-z])")))))


def kebab(text: Column) -> Column:
    """Letters and digits in lower case, whatever stands between them one hyphen."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", "-"), F.lit("-"))


def short_key(key: Column, default: str, most: int = 60) -> Column:
    """At most ``most`` characters without hyphens at the ends; ``default`` for an empty key."""
    return F.coalesce(F.nullif(F.btrim(F.substring(key, 1, most), F.lit("-")), F.lit("")), F.lit(default))


# Filler words that say nothing in a key.
KEY_FILLERS = "this that with from have want need will should would about there which their these those your when what were been into over just like some them then than only".split()


def top_words(text: Column, n: int = 3) -> Column:
    """The first n different words of four bytes or more that are no fillers, without punctuation around them."""
    low = F.transform(fields(F.lower(text)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", ""))
    return F.slice(F.array_distinct(F.filter(low, lambda w: (F.octet_length(w) >= 4) & ~w.isin(KEY_FILLERS))), 1, n)


def make_key(text: Column, entities: Column | None = None) -> Column:
    """A key from the first three entities, or else words, of a text."""
    words = top_words(text)
    if entities is not None:
        words = F.when(F.size(entities) > 0, F.slice(entities, 1, 3)).otherwise(words)
    return short_key(kebab(F.array_join(words, " ")), "note")


def dedupe_key(key: Column, n: Column) -> Column:
    """The key of the n-th further row of that name: -a to -z, then -x."""
    return F.when(n < 1, key).otherwise(F.concat(key, F.lit("-"), F.when(n > 26, F.lit("x")).otherwise(F.char(F.lit(96) + n))))


def user_turns(content: Column) -> Column:
    """What the lines 'user: ...' of a transcript say."""
    lines = F.filter(F.split(content, "\n"), lambda x: F.startswith(x, F.lit("user: ")))
    return F.array_join(F.transform(lines, lambda x: F.substring(x, 7, 1 << 30)), "\n")


def highlight(content: Column, terms: Column) -> Column:
    """Lines of more than ten characters that hold a term, marked by '>>> '."""
    marked = F.transform(F.split(content, "\n"), lambda x: F.when((F.length(F.btrim(x)) > 10) & F.exists(terms, lambda t: F.contains(F.lower(x), t)), F.concat(F.lit(">>> "), x)).otherwise(x))
    return F.array_join(marked, "\n")


def paragraphs(content: Column) -> Column:
    """Parts of more than 20 characters between blank lines; a line 'Name: ...' opens a part."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.btrim(x))
    cut = F.transform(lines, lambda x: F.when((x == "") | F.instr(x, ": ").between(2, 25), F.concat(F.lit("\x01"), x)).otherwise(x))
    return F.filter(F.transform(F.split(F.array_join(cut, "\n"), "\x01"), lambda p: F.btrim(p, F.lit(" \n\t\r"))), lambda p: F.length(p) > 20)


def excerpt(content: Column, terms: Column, most: int = 400) -> Column:
    """The paragraph with the most terms (the first of several), widened by those behind and before it while they fit.

    A content of at most ``most`` characters is its own excerpt; one without paragraphs is cut.
    """

    def around(parts: Column) -> Column:
        hits = F.transform(parts, lambda p: F.size(F.filter(terms, lambda t: F.contains(F.lower(p), t))))
        best = F.array_position(hits, F.array_max(hits)).cast("int")
        begin = F.struct(best.alias("lo"), best.alias("hi"), F.length(F.element_at(parts, best)).alias("n"))

        def widen(s: Column, _: Column) -> Column:
            after, ahead = F.length(F.get(parts, s["hi"])), F.length(F.get(parts, s["lo"] - 2))
            room = F.lit(most) - s["n"]
            down = F.struct(s["lo"].alias("lo"), (s["hi"] + 1).alias("hi"), (s["n"] + after).alias("n"))
            up = F.struct((s["lo"] - 1).alias("lo"), s["hi"].alias("hi"), (s["n"] + ahead).alias("n"))
            return F.when((s["n"] < most) & (after <= room), down).when((s["n"] < most) & (s["lo"] > 1) & (ahead <= room), up).otherwise(s)

        return F.aggregate(parts, begin, widen, lambda s: F.array_join(F.slice(parts, s["lo"], s["hi"] - s["lo"] + 1), "\n"))

    return F.when(F.length(content) <= most, content).otherwise(bind(paragraphs(content), lambda p: F.when(F.size(p) == 0, F.substring(content, 1, most)).otherwise(around(p))))
