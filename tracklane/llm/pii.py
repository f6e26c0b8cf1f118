"""Personal data by rules and bootstrapped contextual extraction, in DataFrame functions alone.

Rules find e-mail addresses, IP addresses, card and phone numbers. The bootstrap's instances are whole runs of grouped
digits, and words with digits, an @, an assignment or capitals only, each with what stands before and after it. Seeds
are instances that a rule's span covers, and values assigned to the name of a secret (SECRET). Lexical patterns: what is
assigned to, the words before (and after) together with the form of the value, its form and length, and its first
letters and length. On the graph of patterns and instances, a pattern of SUPPORT confident instances is as confident as
the smoothed mean of all its instances, an instance as the best of its confident patterns; this is repeated
until nothing changes. A form alone proves nothing, since commit hashes look like keys and part numbers like accounts:
an instance needs confident patterns of two kinds, one of them of its context. Instances of high confidence that no
rule knows are added wherever they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, dropped, written

# The rules' patterns. Runs are possessive, and a run is entered at its start or where a match ended, so
# that long runs cost no more than their length; what matches is what the plain forms match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
KINDS = ("email", "ip", "card", "phone", "found")
#: An instance, from the start of a word: seven or more digits with at most two signs between them, or a word of four or
#: more characters with a digit, @, = or _ in it, or one of twelve or more capitals.
INSTANCE = (
    r"(?<![^\x20\x09-\x0D])(?:\(?\+?[0-9](?:[().\x20-]{0,2}+[0-9]){6,}+(?![^\x20\x09-\x0D.,;:!?)\"'\]])"
    r"|(?=[^\x20\x09-\x0D]{4})[^\x20\x09-\x0D0-9@=_]*+[0-9@=_][^\x20\x09-\x0D]*+|[A-Z-]{12,}+)"
)
#: A name and an assignment sign before a value in one word, and a value that looks random.
ASSIGNED = r"^[A-Za-z_][A-Za-z_.-]{1,31}[=:](?!//)[\"']?"
RANDOM = r"^(?=(?:[^0-9]*[0-9]){2})(?=(?:[^A-Za-z]*[A-Za-z]){2})[A-Za-z0-9+/_-]{16,}$"
#: Assignments to names of secrets, lower-cased; what is assigned is a seed if it has SECRET_LENGTH characters.
SECRET = r"(?:^|[^a-z])(?:passwords?|passwd|passphrase|pwd|secrets?|tokens?|apikey|(?:api|access|auth|private|secret)[_-]?keys?|credentials?)[\x20\x09-\x0D]?[=:]$"
SECRET_LENGTH = 8

CONFIDENT, SUPPORT, MIN_DIGITS = 0.6, 3, 5
#: Kinds of patterns that tell the form of a value; the others tell its context.
FORMS = ("form", "head")
STEP = 256


def luhn(digits: Column) -> Column:
    """Whether the checksum of 12 to 19 digits holds."""
    n = F.length(digits)
    value = lambda i: F.ascii(F.substr(digits, i, F.lit(1))) - 48
    twice = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(F.pmod(n - i, F.lit(2)) == 1, twice(value(i))).otherwise(value(i)))
    return F.when(n.between(12, 19), F.pmod(total, F.lit(10)) == 0).otherwise(False)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(OCTETS)
    n = F.length(digits_of(match))
    return luhn(digits_of(match)) if kind == "card" else n.between(9, 15)


def running(lengths: Column) -> Column:
    """Prefix sums of an array of ints, in two levels, so that long arrays take less than the square of their size."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out"))
    part = lambda b: F.slice(lengths, b * STEP + 1, STEP)
    parts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / STEP).cast("int"))
    sums = F.transform(parts, lambda b: F.aggregate(part(b), F.lit(0).cast("long"), lambda a, x: a + x))
    ends = F.aggregate(sums, start, step, lambda a: a["out"])
    blocks = F.zip_with(parts, ends, lambda b, e: F.struct(b.alias("b"), e.alias("e")))
    return F.flatten(F.transform(blocks, lambda x: F.aggregate(part(x["b"]), F.struct((x["e"] - F.aggregate(part(x["b"]), F.lit(0).cast("long"), lambda a, y: a + y)).alias("at"), F.array().cast("array<bigint>").alias("out")), step, lambda a: a["out"])))


NONE = "array<struct<start:bigint,end:bigint,text:string>>"


def _matches(df: DataFrame, name: str, text: str, pattern: str, where: Column) -> DataFrame:
    """df with a column name: the pattern's matches with their code points, where the cheap condition holds."""
    m, p, e = f"__{name}_m", f"__{name}_p", f"__{name}_e"
    df = df.withColumn(m, F.when(where, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), F.length)))
    df = df.withColumn(e, F.when(F.col(p).isNotNull(), running(F.zip_with(p, m, lambda a, b: a + F.length(b)))))
    found = F.zip_with(e, m, lambda end, t: F.struct((end - F.length(t)).alias("start"), end.alias("end"), t.alias("text")))
    return df.withColumn(name, F.coalesce(found, F.array().cast(NONE))).drop(m, p, e)


CONDITION = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def base(df: DataFrame, text: str, out: str = "base") -> DataFrame:
    """df with the rules' spans in column out: array<struct<start, kind, end>>, kind a position in KINDS, sorted."""
    for k in KINDS[:4]:
        df = _matches(df, f"__{k}", text, PATTERN[k], CONDITION[k](F.col(text)))
    of = lambda i, k: F.transform(F.filter(f"__{k}", lambda x: valid(k, x["text"])), lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end")))
    df = df.withColumn(out, F.array_sort(F.concat(*[of(i, k) for i, k in enumerate(KINDS[:4])])))
    return df.drop(*[f"__{k}" for k in KINDS[:4]])


def written_spans(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


WORDS = "array<struct<start:bigint,end:bigint,word:string,left:string,left2:string,right:string>>"


def _surveyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows (key, h, base, words): the rules' spans, and the instances with their contexts; no text."""
    d = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    d = base(d, "text")
    d = d.withColumn("__m", F.when(F.col("text").rlike(r"[0-9@=_]|[A-Z-]{12}"), F.regexp_extract_all("text", F.lit(INSTANCE), F.lit(0))))
    d = d.withColumn("__p", F.when(F.size("__m") > 0, F.split("text", INSTANCE, -1)))
    d = d.withColumn("__e", F.when(F.col("__p").isNotNull(), running(F.zip_with(F.slice("__p", F.lit(1), F.size("__m")), "__m", lambda a, b: F.length(a) + F.length(b)))))
    # contexts lie within 64 characters of the instance
    before = lambda piece, pattern: ascii_lower(F.regexp_extract(F.right(piece, F.lit(64)), pattern, 1))
    lead = lambda m: F.regexp_replace(m, r"^[^\p{L}\p{N}+]+", "")
    core = lambda m: F.regexp_replace(lead(m), r"[^\p{L}\p{N}]+$", "")

    def entry(i: Column) -> Column:
        m, piece, after = F.element_at("__m", i), F.element_at("__p", i), F.element_at("__p", i + 1)
        name = F.regexp_extract(core(m), ASSIGNED, 0)
        start = F.element_at("__e", i) - F.length(lead(m)) + F.length(name)
        value = F.substr(core(m), F.length(name) + 1)
        left = F.when(name != "", ascii_lower(F.regexp_replace(name, "[\"']$", ""))).otherwise(before(piece, r"([^\x20\x09-\x0D]+(?:[\x20\x09-\x0D][=:])?)[\x20\x09-\x0D]*$"))
        left2 = before(piece, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$")
        right = ascii_lower(F.regexp_extract(F.left(after, F.lit(64)), r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1))
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("word"), left.alias("left"), left2.alias("left2"), right.alias("right"))

    w = F.transform(F.sequence(F.lit(1), F.size("__m")), entry)
    odd = lambda x: (F.length(digits_of(x["word"])) >= MIN_DIGITS) | x["word"].rlike(r"@|^[A-Z0-9_-]{12,}$") | x["word"].rlike(RANDOM) | (x["left"].rlike("[=:]$") & (F.length(x["word"]) >= 6))
    d = d.withColumn("words", F.when(F.col("__p").isNotNull(), F.filter(w, odd)))
    return d.select("key", F.xxhash64("text").alias("h"), "base", F.coalesce("words", F.array().cast(WORDS)).alias("words"))


def shape(word: Column) -> Column:
    """The word's runs of digits and of letters of either case."""
    out = word
    for runs, sign in (("[0-9]+", "9"), (r"\p{Lu}+", "A"), (r"\p{L}*[\p{L}&&[^A]]", "a")):
        out = F.regexp_replace(out, runs, sign)
    return out


def patterns(word: Column, left: Column, left2: Column, right: Column) -> Column:
    """The lexical patterns of an instance."""
    form = F.concat_ws("/", shape(word), F.length(word))
    classes = F.concat(*[F.when(word.rlike(p), F.lit(c)).otherwise("") for p, c in (("[0-9]", "9"), (r"\p{Lu}", "A"), (r"\p{Ll}", "a"), ("@", "@"))])
    some = lambda c, name, *parts: F.when(c, F.concat_ws(" ", F.lit(name), *parts))
    return F.array_compact(F.array(
        some(F.lit(True), "form", form),
        some((F.length(word) >= 12) & word.rlike(r"^\p{L}{4}"), "head", F.substring(word, 1, 4), F.length(word)),
        some(left.rlike("[=:]$"), "name", left),
        some(left != "", "left", left, form),
        some(left2 != "", "before", left2, classes),
        some((left != "") & (right != ""), "around", left, right, classes),
    ))


def bootstrap(instances: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Confident words among instances (word, left, left2, right, seed), seeds included: rows (word, confidence).

    Edges are distinct pairs of word and pattern. A pattern needs SUPPORT confident words; its confidence is the sum of
    its words' confidence over their number and one; from CONFIDENT on it counts for its words, which take the best of
    theirs if these are of two kinds, one of them no form. Confidences are cut to hundredths and only rise, so rounds end.
    """
    spark, old, keep = instances.sparkSession, [], [] if keep is None else keep
    edges = written(instances.select("word", F.col("seed").cast("int").alias("seed"), F.explode(patterns(*map(F.col, ("word", "left", "left2", "right")))).alias("pattern")).groupBy("word", "pattern").agg(F.max("seed").alias("seed")), old)
    words = written(edges.groupBy("word").agg(F.max("seed").alias("seed")), old)
    # patterns that can't get SUPPORT take no part
    able = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    edges = written(edges.join(able, "pattern").select("word", "pattern", "n"), old)
    state = written(words.withColumn("p", F.col("seed") * 100), now := [])
    before = None
    while True:
        strong = edges.join(state.where("p > 0").select("word", "p"), "word").groupBy("pattern", "n").agg(F.sum("p").alias("sum"), F.count("*").alias("support"))
        strong = strong.select("pattern", F.floor(F.col("sum") / (F.col("n") + 1)).cast("int").alias("q")).where((F.col("q") >= int(100 * CONFIDENT)) & (F.col("support") >= SUPPORT))
        kind = F.split_part("pattern", F.lit(" "), F.lit(1))
        told = edges.select("word", "pattern").join(strong, "pattern").groupBy("word").agg(F.max("q").alias("q"), F.count_distinct(kind).alias("kinds"), F.max((~kind.isin(*FORMS)).cast("int")).alias("context"))
        told = told.where("kinds > 1 AND context = 1").select("word", "q")
        last, now = now, []
        state = written(state.join(told, "word", "left").select("word", "seed", F.greatest(F.col("p"), F.coalesce("q", F.lit(0))).alias("p")), now)
        after = state.agg(F.sum("p")).first()[0]
        dropped(spark, last)
        if after == before:
            break
        before = after
    found = written(state.where("p > 0").select("word", (F.col("p") / 100).alias("confidence")), keep)
    dropped(spark, old + now)
    return found


def extracted(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The survey (key, h, base) of every row and, by (key, h), the spans that the bootstrap adds."""
    survey = written(_surveyed(docs, text, key))
    covered = lambda w: F.exists("base", lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"]))
    seen = survey.where(F.size("words") > 0).select("key", "h", F.explode(F.transform("words", lambda w: w.withField("known", covered(w)))).alias("w")).select("key", "h", "w.*")
    secret = F.col("left").rlike(SECRET) & (F.length("word") >= SECRET_LENGTH)
    seen = written(seen.withColumn("seed", F.col("known") | secret))
    found = bootstrap(seen)
    hits = seen.where(~F.col("known")).join(found, "word")
    return survey.drop("words"), hits.groupBy("key", "h").agg(F.collect_set(F.struct("start", F.lit(KINDS.index("found")).alias("kind"), "end")).alias("added"))


def personal(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found), one per row of docs.

    Null and empty texts have no spans; null keys and repeated rows each get their row; a table without seeds adds
    nothing; an empty table gives no rows.
    """
    survey, added = extracted(docs, text, key)
    added = written(added).select(F.col("key").alias("k2"), F.col("h").alias("h2"), "added")
    s = survey.join(added, F.col("key").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")), "left")
    s = s.withColumn("added", F.coalesce("added", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    every = F.array_sort(F.concat("base", "added"))
    return s.select(F.col("key").alias(key), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"), written_spans(every).alias("spans"), F.size("added").cast("long").alias("n_found"))


def redacted(docs: DataFrame, text: str = "text", key: str = "doc_id", length: str | None = "n_chars") -> DataFrame:
    """docs with every span of its text replaced by its kind in angle brackets, overlapping spans by the first's;
    the column length, if there is one, follows. All rows and columns stay, whatever the columns' names; null texts
    stay null; null keys and repeated rows are handled like others; an empty table gives no rows."""
    survey, added = extracted(docs, text, key)
    both = survey.where(F.size("base") > 0).select("key", "h", F.col("base").alias("added")).unionByName(added)
    both = written(both.groupBy(F.col("key").alias("k2"), F.col("h").alias("h2")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("added")))).alias("spans")))
    d = docs.select(docs[key].alias("k"), docs[text].alias("t"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    # every span has a digit, an @, an assignment or capitals: rows whose text has none of them need no join
    able = F.coalesce(F.col("t").rlike(r"[0-9@=:_]|[A-Z-]{12}"), F.lit(False))
    x = d.where(able).join(both, F.col("k").eqNullSafe(F.col("k2")) & (F.xxhash64("t") == F.col("h2")), "left")
    t = F.col("t")
    mark = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    piece = lambda a, s: F.when(s["start"] >= a["at"], F.array(F.substr(t, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.element_at(mark, s["kind"] + 1))).otherwise(F.array().cast("array<string>"))
    new = F.aggregate("spans", start, lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], piece(a, s)).alias("out")), lambda a: F.concat(F.array_join(a["out"], ""), F.substr(t, (a["at"] + 1).cast("int"))))
    x = x.withColumn("new", F.when(F.col("spans").isNotNull(), new).otherwise(t))
    own = lambda c: F.col("row")[c]
    count = lambda c: F.when(F.col("spans").isNotNull(), F.length("new").cast(docs.schema[c].dataType)).otherwise(own(c))
    cols = [(F.col("new") if c == text else count(c) if c == length else own(c)).alias(c) for c in docs.columns]
    return x.select(*cols).unionByName(d.where(~able).select("row.*"))
