"""Personal data by patterns, and terms that give it away by what the corpus says of them.

Four kinds of values are found by pattern. They are the protected entities. Every one of them has a neighbourhood: the
words up to ``reach`` before and behind its mentions, no farther than the next match of its kind. Over the whole corpus,
``p(e)`` is the share of words in the neighbourhood of entity ``e``, ``p(t)`` that of term ``t`` and ``p(e, t)`` that of
both. The pointwise mutual information of the two, measured in the information content of the entity itself,
``ln(p(e, t) / (p(e) p(t))) / -ln(p(e))``, is the part of the entity that the term discloses: 1 if the term stands
nowhere else. Terms that disclose ``generalise`` or more are replaced by their entity's kind wherever they stand, in
documents without the entity too, and those that disclose ``remove`` or more are removed. A term must be seen in
``support`` different neighbourhoods of the entity, so that a passage and its copies are one witness.

Only DataFrame functions are used. Patterns are possessive and begin where a run begins, so that they are linear in the
text and need no stack. Places are prefix sums of pieces between matches. Terms are counted per task before they are
exchanged, found by a broadcast up to ``BROADCAST_TERMS`` of them and by an exchange beyond, and documents themselves
are not exchanged: spans come back to them by id and hash of the text.

Null texts are empty; repeated rows are found each, and get the same spans; ids may be null; an empty table gives no
rows. Other columns, whatever their names, pass through ``sanitised``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.shared import free_name, with_computed, written
from episodica.sources.tables import table

KINDS = ("email", "ip", "card", "phone")
#: Further kinds of spans, after ``KINDS`` where they start at one place.
GENERALISED, REMOVED = "generalised", "removed"
#: The contract's patterns, possessive, and begun where a match can begin first: at a run's start or the last match's end.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a kind has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
LETTERS = r"\p{L}++"
BROADCAST_TERMS = 200_000
#: Elements of an array that are summed at once.
BLOCK = 32


@dataclass(frozen=True)
class Disclosure:
    """Words of a neighbourhood on either side, letters of a term, neighbourhoods that must show it, and thresholds."""

    reach: int = 8
    least_letters: int = 3
    support: int = 3
    generalise: float = 0.9
    remove: float = 0.95


DISCLOSURE = Disclosure()


def with_starts(df: DataFrame, name: str, sizes: Column) -> DataFrame:
    """``df`` with the exclusive prefix sums of an array of integers, made block by block.

    An array that grows is copied for each element, so it must stay short; sizes and blocks are computed once per row.
    """

    def running(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    given, blocks = free_name([*df.columns, name], "sizes"), free_name([*df.columns, name], "blocks")
    out = with_computed(df, given, sizes)
    numbers = F.sequence(F.lit(0), F.ceil(F.size(given) / BLOCK).cast("int") - 1)
    parts = F.when(F.size(given) > 0, F.transform(numbers, lambda b: running(F.slice(given, b * BLOCK + 1, BLOCK))))
    out = with_computed(out, blocks, F.coalesce(parts, F.array().cast("array<array<int>>")))
    base = F.slice(running(F.transform(blocks, lambda b: F.element_at(b, -1))), 1, F.size(blocks))
    shifted = F.zip_with(F.col(blocks), base, lambda b, s: F.transform(F.slice(b, 1, F.size(b) - 1), lambda v: v + s))
    return with_computed(out, name, F.flatten(shifted)).drop(given, blocks)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = F.translate(match, " -", "")
        n = F.length(digits)
        doubled = lambda d, i: F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + doubled(F.substring(digits, i, F.lit(1)).cast("int"), i))
        return F.when(n.between(14, 19), luhn % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _value(kind: str, match: Column) -> Column:
    """What makes two mentions one entity."""
    if kind == "email":
        return F.lower(match)
    return match if kind == "ip" else F.regexp_replace(match, "[^0-9]", "")


def _words_from(piece: Column, reach: int) -> Column:
    return F.regexp_extract(piece, rf"^(?:[^\p{{L}}]*+{LETTERS}){{1,{reach}}}", 0)


def _with_kind(docs: DataFrame, text: str, kind: str, name: str, how: Disclosure) -> DataFrame:
    """``docs`` with the array ``name`` of one kind's spans."""
    matches, pieces, starts = (free_name([*docs.columns, name], f"{kind}_{what}") for what in ("matches", "pieces", "starts"))
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(F.col(text), F.lit(PATTERNS[kind]), F.lit(0))
    if NEEDS[kind]:
        found = F.when(F.contains(F.col(text), F.lit(NEEDS[kind])), found).otherwise(none)
    out = with_computed(docs, matches, found)
    out = with_computed(out, pieces, F.when(F.size(matches) > 0, F.split(F.col(text), PATTERNS[kind], -1)).otherwise(none))
    # A piece and the match behind it; the piece behind the last match ends the text.
    out = with_starts(out, starts, F.zip_with(F.slice(pieces, 1, F.size(matches)), F.col(matches), lambda p, m: F.length(p) + F.length(m)))

    def span(k: Column) -> Column:
        before, match, behind = F.get(pieces, k), F.get(matches, k), F.get(pieces, k + 1)
        start = F.get(starts, k) + F.length(before)
        near = F.concat(F.reverse(_words_from(F.reverse(before), how.reach)), F.lit(" "), _words_from(behind, how.reach))
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(match)).alias("end"), _value(kind, match).alias("value"), near.alias("near"))

    every = F.when(F.size(matches) > 0, F.sequence(F.lit(0), F.size(matches) - 1)).otherwise(F.array().cast("array<int>"))
    return with_computed(out, name, F.transform(F.filter(every, lambda k: _valid(kind, F.get(matches, k))), span)).drop(matches, pieces, starts)


def with_spans(docs: DataFrame, text: str, name: str, how: Disclosure = DISCLOSURE) -> DataFrame:
    """``docs`` with an array of ``start, kind, end, value, near``; starts in code points, ``near`` the words around."""
    out, used = docs, []
    for kind in KINDS:
        used.append(free_name([*out.columns, name], f"{kind}_spans"))
        out = _with_kind(out, text, kind, used[-1], how)
    return out.withColumn(name, F.concat(*used)).drop(*used)


def terms_of(text: Column, how: Disclosure = DISCLOSURE) -> Column:
    """The terms of a text in its order, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"\p{{L}}{{{how.least_letters},}}+"), F.lit(0)), F.lower)


def revealing_terms(docs: DataFrame, found: DataFrame, how: Disclosure = DISCLOSURE, text: str = "text") -> DataFrame:
    """``term, disclosed, kind, removed``: terms over the lower threshold, with the kind of the entity they disclose most of.

    ``found`` has the ``spans`` of ``with_spans`` over the same documents.
    """
    mentions = found.select(F.explode("spans").alias("s")).select("s.kind", "s.value", "s.near")
    nearby = mentions.select("kind", "value", F.md5("near").alias("witness"), F.explode(terms_of(F.col("near"), how)).alias("term"))
    pairs = nearby.groupBy("kind", "value", "term", "witness").agg(F.count("*").alias("n")).groupBy("kind", "value", "term")
    pairs = written(pairs.agg(F.sum("n").alias("n_both"), F.count("*").alias("witnesses")), "disclosure-pairs")
    entities = pairs.groupBy("kind", "value").agg(F.sum("n_both").alias("n_entity"))
    candidates = pairs.where(F.col("witnesses") >= how.support)
    counts = written(docs.select(F.explode(terms_of(F.col(text), how)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")), "terms")
    total = counts.agg(F.sum("n_term").cast("double").alias("n_all"))
    joined = candidates.join(entities, ["kind", "value"]).join(counts, "term").crossJoin(F.broadcast(total))  # one row
    both, entity, term, every = (F.col(c).cast("double") for c in ("n_both", "n_entity", "n_term", "n_all"))
    content = F.log(every / F.least(entity, every))
    disclosed = F.log(F.least(both, term) * every / (entity * term)) / content
    best = joined.where(content > 0).select("term", "kind", disclosed.alias("disclosed")).where(F.col("disclosed") >= how.generalise)
    best = best.groupBy("term").agg(F.max(F.struct("disclosed", (-F.col("kind")).alias("rank"))).alias("best"))
    return best.select("term", "best.disclosed", (-F.col("best.rank")).alias("kind"), (F.col("best.disclosed") >= how.remove).alias("removed"))


def text_key(text: Column) -> Column:
    """With the id, the name under which a text's spans come back to it."""
    return F.xxhash64(text)


def term_spans(docs: DataFrame, terms: DataFrame, how: Disclosure = DISCLOSURE, text: str = "text") -> DataFrame:
    """``doc_id, key, added``: for texts with ``terms``, the array of ``start, kind, end, value`` of all of them."""
    laid = docs.select("doc_id", text_key(F.col(text)).alias("key"), F.col(text).alias("__text"))
    laid = with_computed(laid, "words", F.regexp_extract_all("__text", F.lit(LETTERS), F.lit(0)))
    laid = with_computed(laid, "gaps", F.transform(F.split("__text", LETTERS, -1), F.length)).drop("__text")
    laid = with_starts(laid, "starts", F.zip_with(F.slice("gaps", 1, F.size("words")), F.col("words"), lambda g, w: g + F.length(w)))
    at = F.transform("words", lambda w, k: F.struct(F.lower(w).alias("term"), (F.get("starts", k) + F.get("gaps", k)).alias("start"), F.length(w).alias("size")))
    words = laid.select("doc_id", "key", F.explode(F.filter(at, lambda w: w["size"] >= how.least_letters)).alias("w")).select("doc_id", "key", "w.*")
    terms = written(terms, "revealing")
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    hits = words.join(terms, "term").select(
        "doc_id",
        "key",
        F.struct("start", (F.lit(len(KINDS)) + F.col("removed").cast("int")).alias("kind"), (F.col("start") + F.col("size")).alias("end"), F.col("kind").alias("value")).alias("span"),
    )
    return hits.distinct().groupBy("doc_id", "key").agg(F.collect_list("span").alias("added"))


def found_spans(docs: DataFrame, how: Disclosure = DISCLOSURE, text: str = "text") -> DataFrame:
    """``doc_id, key, base, added``: spans of values and of terms, one row per document.

    Spans are ``start, kind, end, value``, a term's value being the number of the kind it discloses.
    """
    clean = docs.select("doc_id", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    found = written(with_spans(clean, "text", "spans", how).select("doc_id", text_key(F.col("text")).alias("key"), "spans"), "pii")
    added = term_spans(clean, revealing_terms(clean, found, how), how)
    added = added.select(F.col("doc_id").alias("added_id"), F.col("key").alias("added_key"), "added")
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    joined = found.join(added, F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("key") == F.col("added_key")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:int>>")
    return joined.select("doc_id", "key", F.array_sort(base).alias("base"), F.array_sort(F.coalesce("added", none)).alias("added"))


def spelled(spans: Column) -> Column:
    """Spans in order, as ``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, GENERALISED, REMOVED)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _bare(spans: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def sanitised(docs: DataFrame, how: Disclosure = DISCLOSURE, text: str = "text") -> DataFrame:
    """``docs`` with values replaced by ``<kind>``, generalised terms by ``<of kind>``, and removed terms left out.

    Spans that begin inside an earlier one are part of it. Null texts stay null.
    """
    spans = found_spans(docs, how, text)
    labels = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    cut = lambda s, label: F.struct(s["start"].alias("start"), s["end"].alias("end"), label.alias("label"))
    base = F.transform("base", lambda s: cut(s, F.get(labels, s["kind"])))
    added = F.transform("added", lambda s: cut(s, F.when(s["kind"] == len(KINDS), F.concat(F.lit("<of "), F.get(F.array(*[F.lit(k) for k in KINDS]), s["value"]), F.lit(">"))).otherwise("")))
    # Longer spans first where two begin at one place.
    ordered = F.transform(F.array_sort(F.transform(F.concat(base, added), lambda s: F.struct(s["start"], -s["end"], s["label"]))), lambda s: F.struct(s["start"].alias("start"), (-s["col2"]).alias("end"), s["label"].alias("label")))
    row, key = (free_name(docs.columns, stem) for stem in ("span_id", "span_key"))
    cuts, kept, last = (free_name(docs.columns, stem) for stem in ("cuts", "kept", "last"))
    named = spans.select(F.col("doc_id").alias(row), F.col("key").alias(key), ordered.alias(cuts)).where(F.size(cuts) > 0).dropDuplicates([row, key])
    body = F.col(f"`{text}`")
    joined = docs.join(named, F.col("doc_id").eqNullSafe(F.col(row)) & (text_key(F.coalesce(body.cast("string"), F.lit(""))) == F.col(key)), "left")
    kind = "struct<at:int,kept:array<struct<start:int,end:int,label:string>>>"
    scanned = F.aggregate(
        F.col(cuts),
        F.expr(f"cast(named_struct('at', 0, 'kept', array()) as {kind})"),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["kept"], F.array(s)).alias("kept"))),
    )
    joined = with_computed(with_computed(joined, last, scanned), kept, F.col(last)["kept"])
    parts = F.transform(
        F.col(kept),
        lambda s, k: F.concat(F.substring(body, F.when(k > 0, F.get(kept, k - 1)["end"]).otherwise(0) + 1, s["start"] - F.when(k > 0, F.get(kept, k - 1)["end"]).otherwise(0)), s["label"]),
    )
    tail = F.substring(body, F.col(last)["at"] + 1, F.length(body))
    clean = F.when(F.size(kept) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(body)
    return joined.select(*[(clean.alias(text) if c == text else F.col(f"`{c}`")) for c in docs.columns])


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of values, digest of their spans, and all spans, for every document."""
    found = found_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda k: k == F.lit(of))).cast("long").alias(f"n_{kind}") for of, kind in enumerate(KINDS)]
    every = F.array_sort(F.concat(_bare("base"), _bare("added")))
    return found.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(every).alias("spans"))


_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_SQL_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0",
    "card": f"""length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
      CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN {_DIGITS}[i]::INT ELSE {_DIGITS}[i]::INT * 2 - CASE WHEN {_DIGITS}[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0""",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}
_SQL_VALUE = {"email": "lower(m)", "ip": "m", "card": _DIGITS, "phone": _DIGITS}
_NEAR = rf"^(?:[^\p{{L}}]*\p{{L}}+){{1,{DISCLOSURE.reach}}}"
_TERM = rf"\p{{L}}{{{DISCLOSURE.least_letters},}}"
_MATCHES = "\n  UNION ALL\n".join(
    f"""  SELECT rid, {KINDS.index(k)} AS kind, start, start + length(m) AS stop, {_SQL_VALUE[k]} AS value, reverse(regexp_extract(reverse(before), '{_NEAR}', 0)) || ' ' || regexp_extract(behind, '{_NEAR}', 0) AS near
  FROM (
    SELECT rid, ms[i] AS m, ps[i] AS before, ps[i + 1] AS behind,
           (list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0))::BIGINT AS start
    FROM (SELECT rid, ms, ps, unnest(range(1, len(ms) + 1)) AS i
          FROM (SELECT rid, regexp_extract_all(text, '{_PLAIN[k]}') AS ms, string_split_regex(text, '{_PLAIN[k]}') AS ps FROM d))
  ) WHERE {_SQL_VALID[k]}"""
    for k in KINDS
)
_NAMES = "[" + ", ".join(f"'{k}'" for k in (*KINDS, GENERALISED, REMOVED)) + "]"
_SPELL = f"coalesce(string_agg({_NAMES}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind){{}}, '')"
OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), base AS (
{_MATCHES}
), nearby AS (SELECT kind, value, near, lower(unnest(regexp_extract_all(near, '{_TERM}'))) AS term FROM base
), pairs AS (SELECT kind, value, term, count(*) AS n_both, count(DISTINCT near) AS witnesses FROM nearby GROUP BY kind, value, term
), entities AS (SELECT kind, value, count(*) AS n_entity FROM nearby GROUP BY kind, value
), counts AS (SELECT term, count(*) AS n_term FROM (SELECT lower(unnest(regexp_extract_all(text, '{_TERM}'))) AS term FROM d) GROUP BY term
), n AS (SELECT sum(n_term)::DOUBLE AS n_all FROM counts
), disclosed AS (
  SELECT term, max(ln(least(n_both, n_term)::DOUBLE * n_all / (n_entity::DOUBLE * n_term)) / ln(n_all / n_entity)) AS disclosed
  FROM pairs JOIN entities USING (kind, value) JOIN counts USING (term), n WHERE witnesses >= {DISCLOSURE.support} AND n_entity < n_all GROUP BY term
), words AS (
  SELECT rid, lower(w) AS term, length(w) AS size,
         (sum(length(g) + length(w)) OVER (PARTITION BY rid ORDER BY i) - length(w))::BIGINT AS start
  FROM (SELECT rid, i, ws[i] AS w, gs[i] AS g FROM (
    SELECT rid, ws, gs, unnest(range(1, len(ws) + 1)) AS i
    FROM (SELECT rid, regexp_extract_all(text, '\\p{{L}}+') AS ws, string_split_regex(text, '\\p{{L}}+') AS gs FROM d)))
), added AS (
  SELECT rid, {len(KINDS)} + (disclosed >= {DISCLOSURE.remove})::INT AS kind, start, start + size AS stop
  FROM words JOIN disclosed USING (term) WHERE disclosed >= {DISCLOSURE.generalise}
), spans AS (SELECT rid, kind, start, stop FROM base UNION ALL SELECT * FROM added
), g AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{kind}" for k, kind in enumerate(KINDS))},
         sha256({_SPELL.format(f" FILTER (kind < {len(KINDS)})")}) AS base_sha256, {_SPELL.format("")} AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in KINDS)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
