"""Personal data: base patterns, and terms that give protected entities away, in SQL functions.

Base values are found by one regex a kind; starts and ends come from the lengths of the pieces between
matches. The second part is information-theoretic. Protected entities are the values (of those, all that
MIN_DOCS documents hold), the kinds, and ``secret``: that a text assigns something to one of the NAMES. A term is a word, or the shape
of a token that mixes letters and digits (its alphabet and length), by which tokens that occur once are known, too. Over
the whole corpus, the documents that hold a term and an entity are counted: they give the share of the term's
documents that hold the entity, and how much of the entity's surprise the term removes (pointwise mutual information over
the entity's own information, 1 at most for any frequency). A term above both thresholds, seen with the
entity in ``MIN_DOCS`` documents and more often than chance allows over all pairs tried, discloses it; a kind or a secret only
if those documents hold different values of it, so that copies of one document disclose its value at most. Each of a term's
places in any text becomes a span of kind ``term``. ``sanitize`` generalises values to their kind and removes disclosing terms.

Defined results: null and empty texts have no spans. Repeated rows count as documents of their own. Words within values,
the NAMES, and the first and last word of a text (which may be cut) aren't counted with an entity.
A term within a value is none of its own; one that reaches beyond stays. Rows whose spans can't be joined by id are told apart by a row number. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, read, running, small

#: The kinds' patterns. Possessive where nothing can be given back, so that they
#: match the same and long runs cost no backtracking; \G lets a match start where the last one ended.
KINDS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    ("ip", r"[0-9]++(?:\.[0-9]++){3}+", r"[0-9]\.[0-9]"),
    ("card", r"[0-9]++(?:[\x20-][0-9]++)*+", r"(?:[0-9][\x20-]?){12}[0-9]"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
TERM = r"\p{L}[\p{L}\p{N}]{3,}"
#: What a credential is called where a text assigns one.
NAMES = ("token", "secret", "password", "passwd", "passphrase", "pwd", "pin", "apikey", "api_key", "api-key", "access_key", "private_key", "credential", "credentials", "ssn", "iban", "passport")
ASSIGNED = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(NAMES)})[\"']?[\x20]?[:=]"
GIVEN = ASSIGNED + r"\s*[^\s]*"
#: A token that mixes letters and digits, long enough to be told by its shape.
TOKEN = r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{12,}+"
SECRET = "[secret]"
MIN_DOCS = 3
MIN_SHARE = 0.6  # of the term's documents
MIN_REMOVED = 0.5  # of the value's surprise
CHANCE = 0.01  # that any pair passes by chance, at most


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    d = _digits(c)
    n = F.length(d)

    def part(i: Column) -> Column:
        v = F.substr(d, i, F.lit(1)).cast("int")
        twice = v * 2 - F.when(v > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, c: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(c, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(_digits(c))
        return F.when(n.between(13, 19), _luhn(c)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(c)).between(9, 15)
    return F.lit(True)


_NONE = "cast(array() as array<struct<start:int,end:int,text:string>>)"


def spans(text: Column, pattern: str | Column) -> Column:
    """(start, end, text) of a pattern's matches, leftmost and without overlaps, in code points."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def place(z: Column) -> Column:
        sized = F.transform(z, lambda x: F.struct(F.char_length(x["p"]).alias("gap"), F.char_length(x["m"]).alias("width"), x["m"].alias("text")))
        before = running(F.transform(z, lambda x: F.char_length(x["p"]) + F.char_length(x["m"])))
        both = F.arrays_zip(sized.alias("s"), F.slice(before, F.lit(1), F.size(z)).alias("at"))
        return F.transform(both, lambda x: F.struct((x["at"] + x["s"]["gap"]).alias("start"), (x["at"] + x["s"]["gap"] + x["s"]["width"]).alias("end"), x["s"]["text"].alias("text")))

    return let(F.filter(zipped, lambda x: x["m"].isNotNull()), place)


def _check(kind: str):
    return lambda s: _holds(kind, s["text"])


def base_spans(text: Column) -> dict[str, Column]:
    """A column of spans for each kind; each pattern runs only where a cheap test says that it may match."""
    return {kind: F.when(text.rlike(test), F.filter(spans(text, pattern), _check(kind))).otherwise(F.expr(_NONE)) for kind, pattern, test in KINDS}


def shape(token: Column) -> Column:
    """What is left of a token that mixes letters and digits if its characters are forgotten: alphabet and length; else null."""
    alphabet = F.when(token.rlike("^[0-9a-f]+$"), "hex").when(token.rlike("^[0-9A-F]+$"), "HEX").otherwise("mix")
    return F.when(token.rlike("[A-Za-z]") & token.rlike("[0-9]"), F.concat(F.lit("#"), alphabet, F.char_length(token).cast("string")))


def terms_of(text: Column) -> Column:
    """Distinct (key, shown) of a text: words by their lower case, tokens by their shape."""
    word = F.transform(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))), lambda w: F.struct(w.alias("key"), w.alias("shown")))
    token = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))), lambda t: F.struct(shape(t).alias("key"), t.alias("shown")))
    return F.concat(word, F.filter(token, lambda t: t["key"].isNotNull()))


def _counted(text: Column) -> Column:
    """Text without values, names and the runs of letters at its edges."""
    for pattern in (KINDS[0][1], ASSIGNED):
        text = F.regexp_replace(text, pattern, " ")
    return F.regexp_replace(F.regexp_replace(text, r"^[\p{L}\p{N}]++", ""), r"(?<![\p{L}\p{N}])[\p{L}\p{N}]++$", "")


def disclosing(docs: DataFrame, total: int, min_docs: int, min_share: float, min_pmi: float, min_removed: float) -> DataFrame:
    """(entity, term) that disclose. ``docs``: (_row, _text, _values, _classes): the values, and the kinds as (entity, held), a hash of their values there."""
    held = docs.filter("size(_classes) > 0")
    # a value in few documents can't be disclosed: the rest is small beside the words
    values = held.select(F.explode("_values").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_value")).filter(F.col("n_value") >= min_docs)
    classes = held.select(F.explode("_classes.entity").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_value"))
    entities = materialize(values.unionByName(classes), "entities")
    either = F.concat(F.transform("_values", lambda v: F.struct(v.alias("entity"), F.lit(0).cast("long").alias("held"))), "_classes")
    sites = held.select("_row", F.explode(either).alias("e")).join(small(entities.select("entity")), F.col("e.entity") == F.col("entity"), "left_semi")
    sites = materialize(sites.groupBy("_row").agg(F.collect_set("e").alias("entities")), "sites")
    rows = held.select("_row", "_text").join(small(sites), "_row")
    keys = F.array_distinct(F.transform(terms_of(_counted(F.col("_text"))), lambda t: t["key"]))
    rows = rows.select("entities", F.explode(keys).alias("term"))
    # how often a term meets any entity bounds its documents from below: with the pairs it ends most common words early
    any_ = F.array(F.struct(F.lit("").alias("entity"), F.lit(0).cast("long").alias("held")))
    met = rows.select("term", F.explode(F.concat("entities", any_)).alias("e")).groupBy("e.entity", "term").agg(F.count("*").alias("n_both"), F.min("e.held").alias("low"), F.max("e.held").alias("high"))
    met = materialize(met.filter(F.col("n_both") >= min_docs), "met")
    least = met.filter("entity = ''").select(F.col("term").alias("t"), F.col("n_both").alias("n_least"))
    met = met.filter("entity <> ''")
    tried = max(met.count(), 1)
    both = met.filter("low < high or entity not like '[%'").join(least, F.col("term") == F.col("t")).filter(F.col("n_both") >= min_share * F.col("n_least")).drop("t", "n_least", "low", "high")
    both = materialize(both.join(small(entities), "entity"), "pairs")
    wanted = materialize(both.select("term").distinct(), "wanted")
    seen = docs.select(F.explode(F.array_distinct(F.transform(terms_of(F.col("_text")), lambda t: t["key"]))).alias("t"))
    counts = seen.join(small(wanted), F.col("t") == F.col("term"), "left_semi").groupBy("t").agg(F.count("*").alias("n_term"))
    both = both.join(counts, F.col("term") == F.col("t"))
    share, base = F.col("n_both") / F.col("n_term"), F.col("n_value") / F.lit(float(total))
    pmi = F.log(share / base)
    # Chernoff's bound on seeing this share by chance, against the number of pairs tried
    other = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    sure = F.col("n_term") * (share * pmi + other) >= F.log(F.lit(tried / CHANCE))
    told = (share >= min_share) & (base < 1) & (share > base) & (pmi >= -min_removed * F.log(base)) & (pmi >= min_pmi) & sure
    return both.filter(told).select("entity", "term")


def _named(kind: str):
    return lambda s: F.concat(F.lit(f"{kind}:"), F.lower(s["text"]))


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_pmi: float = 0.0, min_removed: float = MIN_REMOVED) -> DataFrame:
    """``keep`` columns, an array of (start, end, text) for each kind and for ``term``, and ``clean``, the sanitized text."""
    names = [k for k, _, _ in KINDS]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = src.select("_kept", *[c.alias(f"_{k}") for k, c in base_spans(F.col("_text")).items()], "_text")
    values = F.array_distinct(F.concat(*[F.transform(f"_{k}", _named(k)) for k in names]))
    kind = lambda name, of: F.when(F.size(of) > 0, F.struct(F.lit(name).alias("entity"), F.xxhash64(F.array_sort(F.array_distinct(of))).alias("held")))
    given = F.when(F.col("_text").rlike(ASSIGNED), F.regexp_extract_all("_text", F.lit(GIVEN), F.lit(0)))
    classes = F.array_compact(F.array(*[kind(f"[{k}]", F.transform(f"_{k}", lambda s: s["text"])) for k in names], kind(SECRET, given)))
    found = found.withColumns({"_values": values, "_classes": classes, "_row": F.monotonically_increasing_id()})
    found = materialize(found, "spans")
    told = disclosing(found, found.count(), min_docs, min_share, min_pmi, min_removed)
    # every place of a disclosing term, in texts that lack the entity too; a pattern holds the terms of its text
    terms = materialize(told.select("term").distinct(), "disclosing")
    here = found.select("_row", F.explode(terms_of(F.col("_text"))).alias("t")).select("_row", "t.*")
    here = here.join(small(terms), F.col("key") == F.col("term"), "left_semi").groupBy("_row").agg(F.array_join(F.array_sort(F.collect_set("shown")), "|").alias("_any"))
    here = materialize(here.withColumnRenamed("_row", "_r"), "terms")
    out = found.join(small(here), F.col("_row") == F.col("_r"), "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L}\p{N}{0,30})(?:"), F.col("_any"), F.lit(r")(?![\p{L}\p{N}])"))
    out = out.withColumn("_terms", F.when(F.col("_any").isNotNull(), spans(F.col("_text"), pattern)))
    free = lambda base: F.filter(F.coalesce("_terms", F.expr(_NONE)), lambda t: ~F.exists(base, lambda s: (s["start"] <= t["start"]) & (t["end"] <= s["end"])))
    out = out.withColumn("_term", let(F.concat(*[F.col(f"_{k}") for k in names]), free))
    # a row of its own, so that what follows doesn't find the spans once more
    out = out.withColumn("_clean", F.when(F.greatest(*[F.size(f"_{k}") for k in [*names, "term"]]) > 0, sanitize(F.col("_text"), *[F.col(f"_{k}") for k in [*names, "term"]])).otherwise(F.col("_text")))
    return out.select("_kept.*", *[F.col(f"_{k}").alias(k) for k in [*names, "term"]], F.col("_clean").alias("clean"))


def _mark(kind: str):
    by = F.lit("" if kind == "term" else f"[{kind}]")
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), by.alias("by"))


def sanitize(text: Column, email: Column, ip: Column, card: Column, phone: Column, term: Column) -> Column:
    """Text with values generalised to their kind and disclosing terms removed; the first of overlapping spans wins."""
    cols = {"email": email, "ip": ip, "card": card, "phone": phone, "term": term}
    all_spans = F.array_sort(F.concat(*[F.transform(c, _mark(k)) for k, c in cols.items()]))
    done = F.aggregate(
        all_spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["by"]).alias("out"))),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.lit(2**31 - 1)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, n_term and n_spans (all spans), and clean_sha256, the digest of the sanitized text."""
    found = find(read(spark, sf_dir, "documents"))
    shown = lambda k: F.transform(k, lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))
    names = [k for k, _, _ in KINDS]
    base = F.concat(*[shown(k) for k in names])
    n_spans = sum((F.size(k) for k in [*names, "term"]), F.lit(0)).cast("long")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in names], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, shown("term")), ",").alias("spans"),
        F.size("term").cast("long").alias("n_term"), n_spans.alias("n_spans"), F.sha2("clean", 256).alias("clean_sha256"),
    )
