"""Text and domain expressions: columns in, columns out, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rules

DOMAIN = r"^[a-z0-9-]+\.[a-z]{2,}$"
SENTENCE_BREAK = r"\n+|\.\s{2,}|\.\s+(?=[A-Z])"
BARE_TLDS = "com|ai|io|net|org|co|tech|app|dev|xyz|so|vc|cloud|studio|ventures|fund|global|systems|company"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often it is used, inside lambdas too."""
    return F.transform(F.array(value), use)[0]


def contains_any(text: Column, words: list[str]) -> Column:
    return let(text, lambda t: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)))


def contained(text: Column, patterns: list[str]) -> Column:
    """The structs (at, pattern) of patterns that a text contains, in order. The text is computed once; a pattern costs one byte search.

    Over 40 MB of texts 82 patterns take 0.7 s besides the 2.4 s of normalizing. Looking the texts' distinct words up in a
    dictionary by hash took 1.4 s, and 12 s against 14 s at 900 patterns, so there is none.
    """
    table = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(p).alias("pattern")) for i, p in enumerate(patterns)])
    return let(text, lambda t: F.filter(table, lambda p: F.contains(t, p["pattern"])))


def parse_result_age(date_str: Column, as_of: Column) -> Column:
    """Days of 'N hours/days/weeks/months/years ago' or of four date formats; 999 if it is neither."""
    low = F.lower(F.trim(date_str))
    found = F.regexp_extract(low, r"(\d+)", 1)
    n = F.when(found == "", 1).otherwise(F.try_to_number(F.substring(found, 1, 9), F.lit("999999999")).cast("int"))
    has = lambda w: F.contains(low, F.lit(w))
    ago = has("ago")
    day = F.coalesce(*[F.try_to_timestamp(F.trim(date_str), F.lit(f)) for f in ("MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "yyyy-MM-dd")])
    return (
        F.when(date_str.isNull() | (date_str == ""), 999).when(has("hour"), 0).when(has("day") & ago, n).when(has("week"), n * 7)
        .when(has("month") & ago, n * 30).when(has("year") & ago, n * 365)
        .when(day.isNotNull(), F.greatest(F.lit(0), F.datediff(as_of, F.to_date(day)))).otherwise(999)
    )


def age_to_weight(date_str: Column, as_of: Column) -> Column:
    """Weight of a search hit by age: 1.0 to 180 days, 0.6 to 548 or without a date, else 0.3."""
    days = parse_result_age(date_str, as_of)
    return F.when(date_str.isNull() | (date_str == ""), 0.6).when(days <= 180, 1.0).when(days <= 548, 0.6).otherwise(0.3)


def pub_date_weight(published: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, F.to_date(published))
    return F.when(days.isNull(), 0.6).when(days <= 365, 1.0).when(days <= 730, 0.6).otherwise(0.3)


def strength_of(weight: Column) -> Column:
    return F.when(weight == 1.0, "STRONG").when(weight == 0.6, "MEDIUM").when(weight == 0.3, "WEAK")


def scan_text(text: Column) -> Column:
    """Lower case, anything but a-z, 0-9 and spaces a space, padded."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]", " "), F.lit(" "))


def keyword_hits(text: Column, keywords: dict[str, list[str]], normalize_keywords: bool = False) -> Column:
    """The structs (provider_name, keywords) of providers that a text names. Keywords with punctuation never match unless normalized."""
    clean = (lambda k: "".join(c if c.isalnum() or c == " " else " " for c in k.lower())) if normalize_keywords else (lambda k: k)
    every = [(p, clean(k)) for p, words in keywords.items() for k in words]
    names, ends = list(keywords), []
    for words in keywords.values():
        ends.append((ends[-1] if ends else 0) + len(words))
    spans = F.array(*[F.struct(F.lit(p).alias("provider_name"), F.lit(end - len(keywords[p])).alias("first"), F.lit(end).alias("end")) for p, end in zip(names, ends, strict=True)])
    of = lambda hits, s: F.transform(F.filter(hits, lambda h: (h["at"] >= s["first"]) & (h["at"] < s["end"])), lambda h: h["pattern"])
    by_name = lambda hits: F.transform(spans, lambda s: F.struct(s["provider_name"].alias("provider_name"), of(hits, s).alias("keywords")))
    return let(contained(scan_text(text), [k for _, k in every]), lambda hits: F.when(F.size(hits) > 0, F.filter(by_name(hits), lambda h: F.size(h["keywords"]) > 0)).otherwise(F.filter(by_name(hits), lambda h: F.lit(False))))


def keyword_scan(df: DataFrame, text_col: str, keywords: dict[str, list[str]], normalize_keywords: bool = False) -> DataFrame:
    """df with a row per matched provider: provider_name, keywords."""
    found = df.withColumn("_hit", F.explode(keyword_hits(F.col(text_col), keywords, normalize_keywords)))
    return found.select(*df.columns, "_hit.provider_name", "_hit.keywords")


def split_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK), lambda s: F.trim(s)), lambda s: s != "")


def term_classify(df: DataFrame, terms: list[tuple] = rules.PROVIDER_TERMS) -> DataFrame:
    """Rows (id, title, summary, company, domain) with each provider of a contained term: first term in order wins.

    In a title with semicolons only clauses that name the company or its domain's first label count, if any does.
    """
    title, stem = F.lower("title"), F.split(F.lower(F.coalesce("domain", F.lit(""))), r"\.")[0]
    names = lambda c: F.contains(c, F.lower("company")) | ((stem != "") & F.contains(c, stem))
    clauses = F.when(F.contains(title, F.lit(";")), F.filter(F.split(title, ";"), names))
    head = let(clauses, lambda cs: F.when(F.size(cs) > 0, F.array_join(F.transform(cs, lambda c: F.trim(c)), " ")).otherwise(title))
    text = F.concat(F.lit(" "), head, F.lit(" "), F.lower(F.coalesce("summary", F.lit(""))), F.lit(" "))
    facts = F.array(*[F.struct(F.lit(term).alias("term"), F.lit(kind).alias("provider_type"), F.lit(name).alias("provider_name"), F.lit(float(m)).alias("multiplier")) for term, kind, name, m in terms])
    found = let(contained(text, [t[0] for t in terms]), lambda hits: F.transform(hits, lambda h: F.get(facts, h["at"])))
    first = lambda told: F.filter(told, lambda x, i: ~F.exists(F.slice(told, 1, i), lambda y: y["provider_name"] == x["provider_name"]))
    return df.withColumn("_told", F.explode(let(found, first))).select(*df.columns, "_told.*")


def valid_title(title: Column, company: Column, domain: Column) -> Column:
    """The title holds the company or, as a word, its domain's first label, but not 'the <company>'."""
    low, name = F.lower(title), F.lower(company)
    stem = F.split(F.lower(F.coalesce(domain, F.lit(""))), r"\.")[0]
    quoted = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    collides = F.regexp(low, F.concat(F.lit(r"(?:^|[\s,])the\s+"), quoted(name)))
    as_word = (stem != "") & F.regexp(low, F.concat(F.lit(r"\b"), quoted(stem), F.lit(r"\b")))
    return ~collides & (as_word | F.contains(low, name))


def company_hint(title: Column) -> Column:
    """Company named before a funding verb in a headline, lower case; null if there is none of two letters or more."""
    verbs = "raises?|raised|secures?|secured|closes?|closed|gets?|nabs?|lands?|bags?|receives?|scoops?|pulls?|snares?|walks?|completes?|announces?"
    name = F.trim(F.regexp_extract(title, rf"(?i)(?:startup\s+)?([A-Z][A-Za-z0-9\s.\-&]+?)\s+(?:{verbs})\s", 1))
    name = F.regexp_replace(name, r"(?i)^(?:startup|company|firm|platform)\s+", "")
    name = F.regexp_replace(name, "^[A-Z][a-z]+(?:'s|’s)\\s+", "")
    name = F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")
    return F.when(F.length(name) >= 2, name)


def title_key(title: Column) -> Column:
    kept = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}\s]", "")
    return F.substring(F.trim(F.regexp_replace(kept, r"\s+", " ")), 1, 60)


def is_valid_domain(domain: Column, rejected: list[str] = rules.REJECTED_DOMAINS) -> Column:
    """A registrable name, not a rejected site (substring rule), two labels or three with a known country ending."""
    d = F.regexp_replace(F.lower(F.trim(domain)), r"^www\.", "")
    labels = F.split(d, r"\.")
    country = F.element_at(labels, -2).isin("co", "com", "net", "org", "gov") & F.element_at(labels, -1).isin("uk", "au", "nz", "za", "jp", "in", "br", "mx")
    shape = d.rlike(r"^[a-z0-9][a-z0-9\-]*\.[a-z]{2,}(?:\.[a-z]{2})?$")
    return F.coalesce(shape & ~contains_any(d, rejected) & ((F.size(labels) == 2) | country), F.lit(False))


def apex_domain(host: Column, multi_part: list[str] = rules.MULTI_PART_TLDS) -> Column:
    labels = F.split(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.")
    n = F.size(labels)
    last2 = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    last3 = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
    return F.when((n >= 3) & last2.isin(list(multi_part)), last3).otherwise(last2)


def extract_domain(text: Column) -> Column:
    """First valid host of a URL, else the first valid bare domain with a listed ending."""
    low = F.lower(text)
    urls = F.filter(F.regexp_extract_all(low, F.lit(r"https?://([a-z0-9-]+\.[a-z]{2,})"), F.lit(1)), lambda x: is_valid_domain(x))
    bare = F.filter(F.regexp_extract_all(low, F.lit(rf"\b([a-z0-9-]+\.(?:{BARE_TLDS}))\b"), F.lit(1)), lambda x: is_valid_domain(x))
    return F.coalesce(F.get(urls, F.lit(0)), F.get(bare, F.lit(0)))


def clean_website_event(site: Column, rejected: list[str] = rules.REJECTED_SITES) -> Column:
    v = F.regexp_replace(F.regexp_replace(site, "https?://", ""), "^/+|/+$", "")
    return F.when(~contains_any(F.lower(v), rejected) & F.lower(v).rlike(DOMAIN), v)


def clean_website_startup(site: Column) -> Column:
    v = F.lower(F.trim(F.split(F.regexp_replace(site, "https?://", ""), "/")[0]))
    return F.when(v.rlike(DOMAIN), v)


def normalize_round(name: Column, rounds: dict[str, str] = rules.ROUNDS) -> Column:
    v = F.upper(F.trim(name))
    exact, part = [F.when(v == k, r) for k, r in rounds.items()], [F.when(F.contains(v, F.lit(k)), r) for k, r in rounds.items()]
    return F.coalesce(*exact, *part, v)


def normalize_company_name(name: Column) -> Column:
    """One legal suffix off, trimmed; letters after a letter lower case, all others upper case ('c2i' -> 'C2I')."""
    bare = F.lower(F.trim(F.regexp_replace(name, r"(?i)\s+(Inc\.?|LLC|Ltd\.?|Corporation|Corp\.?)$", "")))
    chars = F.filter(F.split(bare, ""), lambda c: c != "")
    cased = F.transform(chars, lambda c, i: F.when((i == 0) | ~F.coalesce(F.get(chars, i - 1), F.lit("")).rlike(r"\p{L}"), F.upper(c)).otherwise(c))
    return F.array_join(cased, "")


def is_competitor_url(url: Column, slugs: list[str] = rules.COMPETITOR_SLUGS) -> Column:
    return contains_any(F.lower(url), slugs)


def homepage_investors(df: DataFrame, text_col: str, priors: dict = rules.INVESTOR_PRIORS) -> DataFrame:
    """df with a row per provider that an investor named after a backer phrase stands for; first one wins."""
    phrase = (
        r"(?i)(?:backed by|investors include|funded by|supported by|investment from|our investors|raised\s+(?:\$[\d.,]+\s*[MBK]?\s+)?from|"
        r"with participation from|with support from)\s*[:—\-]?\s*([^.\n)]{0,300})"
    )
    names = F.flatten(F.transform(F.regexp_extract_all(text_col, F.lit(phrase), F.lit(1)), lambda w: F.split(w, r"(?i),|;|\band\b")))
    tidy = F.filter(F.transform(names, lambda n: F.trim(F.regexp_replace(F.trim(n), "^[\"']+|[\"']+$", ""))), lambda n: (n != "") & (F.length(n) <= 60) & ~n.rlike(r"\d"))
    table = F.broadcast(df.sparkSession.createDataFrame([(i, k, p, why) for i, (k, (p, why)) in enumerate(priors.items())], "prior_ord int, prior string, provider_name string, rationale string"))
    spread = df.select("*", F.monotonically_increasing_id().alias("_id")).select("*", F.posexplode(tidy).alias("_pos", "candidate"))
    hits = spread.join(table, F.contains(F.lower("candidate"), F.col("prior")))
    first = F.row_number().over(Window.partitionBy("_id", "provider_name").orderBy("_pos", "prior_ord"))
    return hits.withColumn("_n", first).where("_n = 1").select(*df.columns, "candidate", "provider_name", "rationale")
