"""Operator 4: personal data by patterns, and terms that give it away.

Base spans are e-mail and IP addresses, card and phone numbers.  Their values
are the protected entities; values of one e-mail domain, network, card issuer
or phone prefix are a group, which stands in for values too rare to learn from.
Every term of a document with an entity is tested for how strongly it reveals
it over the whole corpus: the pointwise mutual information of term and entity,
log2(P(e | t) / P(e)), is compared with the entity's own information,
-log2 P(e).  P(e | t) is not the observed share but its lower confidence bound
(Wilson's), and the document a term is tried in is not evidence for it: it is
estimated from the others.  So what stands together once says nothing.  The
bound must also make the entity more likely than not: else, the larger the
corpus, the less evidence its rarer entities would ask for.

A term that gives away at least the share ``disclosure`` of an entity's
information is a further span at all its places, in every document: of kind
``term`` if it reveals a value, of kind ``hint`` if only a group.  Redaction
generalises base spans and hints to their kind and removes terms.

Equal texts are one document to the estimates, as copies are no evidence.

Defined cases: a null or empty text has no spans; repeated rows and equal
texts get equal spans; a null id is kept; no rows give no rows.  Other columns
are not read, whatever their names, and kept by ``sanitise``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import add_columns, cut, forget, unused

KINDS = ("email", "ip", "card", "phone", "term", "hint")
TERM, HINT = 4, 5
#: Standard errors between a share and its lower bound.
CONFIDENCE = 1.96
#: Share of an entity's information a term may not give away, and the likelihood it needs besides.
DISCLOSURE, LIKELY = 0.9, 0.5
#: Terms a task counts before it sends the counts on.
COUNTED = 400_000
#: Bits a term has in the map that says which terms matter, and the least and the largest
#: map's bits, as powers of two: 64 MB.  A join decides on its hits, so a full map costs time only.
TERM_BITS, LEAST_BITS, MOST_BITS = 64, 20, 29
#: Documents that an entity and a term must have in common for the bound to be able to reach LIKELY.
LEAST_BOTH = 1 + math.ceil(LIKELY * CONFIDENCE**2 / (1 - LIKELY))
#: About as many documents of one entity have their terms counted together; those of larger entities are dealt into groups.
BESIDE = 128
#: Words of which a worker remembers the terms that matter, about 160 bytes each.
KNOWN = 400_000

#: Fixed patterns, from the definition of the kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# A match cannot begin within a run of digits, as it would have begun before it.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{2,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, found from their @ so that long runs cost no more than once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order of kind, then start."""
    spans = [(0, *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            spans.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            spans.append((2, *m.span()))
    if "+" in text:
        spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


def entity(text: str, span: tuple[int, int, int]) -> str:
    kind, start, end = span
    value = text[start:end]
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else value if kind == 1 else _digits(value)}"


def group(name: str) -> str:
    """What an entity has in common with others: domain, network, issuer or prefix."""
    kind, value = name.split(":", 1)
    if kind == "email":
        shared = value.split("@", 1)[1]
    elif kind == "ip":
        shared = ".".join(value.split(".")[:2])
    else:
        shared = value[: 6 if kind == "card" else 4]
    return f"{kind}*:{shared}"


def free_terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Terms in lower case with start and end, but not within any base span."""
    taken = sorted((s, e) for _, s, e in spans)
    for m in _TERM.finditer(text):
        s, e = m.span()
        i = bisect_left(taken, (e, -1))
        if not any(b > s for _, b in taken[max(0, i - len(KINDS)) : i]):
            yield m[0].lower(), s, e


_SPAN = "struct<kind:int,start:int,end:int>"


def find(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Base spans of each text, its entities and their groups, and the terms of a text that has any, with spaces between."""

    def run(column: pa.Array) -> list:
        spans, terms, names = [], [], []
        for text in column.to_pylist():
            own = base_spans(text) if text else []
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
            terms.append(" ".join(sorted({t for t, _, _ in free_terms(text, own)})) if own else "")
            values = {entity(text, s) for s in own}
            names.append(sorted(values.union(map(group, values))))
        return [spans, terms, names]

    return add_columns(docs, [text_col], f"base array<{_SPAN}>, held string, entities array<string>", run, keep)


class Mattering(dict):
    """Lower-cased terms of a word that are in a bit map; a word is a run of non-space."""

    def __init__(self, held: bytes) -> None:
        super().__init__()
        self.held, self.bits = held, len(held) * 8

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= KNOWN:
            self.clear()
        # Most words are letters with a sign behind them, which no pattern is needed for.
        bare = word.rstrip(".,;:!?")
        terms = ((bare.lower(),) if len(bare) > 1 else ()) if bare.isalpha() else {t.lower() for t in _TERM.findall(word)}
        found = self[word] = tuple(t for t in terms if self._holds(t))
        return found

    def _holds(self, term: str) -> bool:
        a, b = _bits(term, self.bits)
        return bool(self.held[a >> 3] >> (a & 7) & 1) and bool(self.held[b >> 3] >> (b & 7) & 1)

    def of(self, text: str) -> set[str]:
        """Of a text; no term reaches across white space."""
        return set(chain.from_iterable(map(self.__getitem__, set(text.split()))))


def _bits(term: str, bits: int) -> tuple[int, int]:
    """The two places of a term in a map, from the halves of Spark's ``xxhash64``."""
    h = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 42)
    return h % bits, (h >> 32) % bits


def bit_map(terms: DataFrame) -> bytes:
    """A map of some bits per term, of which the two places of each term are set."""
    wanted = terms.count() * TERM_BITS
    bits = 1 << min(max(wanted.bit_length(), LEAST_BITS), MOST_BITS)
    h = F.xxhash64("term")
    places = F.array(*[x.bitwiseAND(F.lit(bits - 1)) for x in (h, F.shiftrightunsigned(h, 32))])
    bit = terms.select(F.explode(places).alias("bit"))
    words = bit.select((F.col("bit") % 64).cast("int").alias("at"), F.shiftright("bit", 6).cast("int").alias("word")).groupBy("word")
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits")).toArrow()
    made = np.zeros(bits // 64, "<i8")
    made[words["word"].to_numpy()] = words["bits"].to_numpy()
    return made.tobytes()


def term_counts(docs: DataFrame, bits: Broadcast, text_col: str = "text") -> DataFrame:
    """Number of documents that hold each term of the map, counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        mattering = Mattering(bits.value)
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])
            counts.clear()
            return made

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(mattering.of(text) if text else ())
                if len(counts) > COUNTED:
                    yield flush()
        yield flush()

    counted = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n_term"))


def _lower_bound(hits: Column, trials: Column) -> Column:
    """Wilson's lower bound of the share that ``hits`` of ``trials`` stand for; 0 of no trials."""
    z2 = CONFIDENCE * CONFIDENCE
    spread = CONFIDENCE * F.sqrt(hits * (trials - hits) / F.greatest(trials, F.lit(1)) + z2 / 4)
    return F.when(trials > 0, (hits + z2 / 2 - spread) / (trials + z2)).otherwise(F.lit(0.0))


def _gives(both: Column, n_term: Column, n_entity: Column, total: int, disclosure: float) -> Column:
    """Whether a term of ``n_term`` documents, ``both`` of them the entity's, gives the entity away."""
    share = n_entity / F.lit(float(total))
    known = _lower_bound(both - 1, n_term - 1)
    return (share < 1) & (known >= LIKELY) & (F.log2(known / share) >= disclosure * -F.log2(share))


def disclosing(found: DataFrame, docs: DataFrame, disclosure: float) -> DataFrame:
    """Terms that give an entity away, with ``exact``: a value, not only a group.

    ``found`` has an ``id`` for each row besides.  Entities that stand in the
    same documents count as one; those of too few to be given away go first.
    The terms of a document cross the network in one piece: to the document's
    copies, then to those of the same entity, where they are counted and terms
    in too few of them go.  A term is tried among the documents with entities
    first: only if it gives one away there, where it stands in fewer documents
    than in all, is it counted in all.  None of this changes the result.
    """
    total = found.agg(F.count_distinct("row")).first()[0]
    with_any = found.where(F.size("entities") > 0)
    # Of equal texts one.
    rows = cut(with_any.groupBy("row").agg(F.count("*").alias("m"), F.min("id").alias("id"), F.first("entities").alias("entities")).drop("row"))
    named = rows.select("id", F.explode("entities").alias("entity"))
    stood = [F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(20,0)")) for k in (1, 2)]
    sets = named.groupBy("entity").agg(F.count("*").alias("n_entity"), F.sha2(F.concat_ws(",", *stood), 256).alias("set")).where(F.col("n_entity") >= LEAST_BOTH)
    sets = sets.select(F.col("entity").alias("_e"), F.xxhash64("entity").alias("_h"), "n_entity", "set")
    named = named.withColumn("h", F.xxhash64("entity")).join(sets, (F.col("entity") == F.col("_e")) & (F.col("h") == F.col("_h")))
    exact = F.bool_or(~F.substring_index("entity", ":", 1).endswith("*")).alias("exact")
    named = named.groupBy("id", "set", "n_entity").agg(exact)
    named = named.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("set", "n_entity", "exact")).alias("sets"))
    rows = rows.select(F.col("id").alias("_own"), "m").join(named, F.col("_own") == F.col("_id"), "left").select("_own", "m", "sets")
    rows = cut(with_any.select("id", "held").join(rows, F.col("id") == F.col("_own")).select("id", "m", "sets", "held"))

    each = F.explode(F.split("held", " ")).alias("term")
    # Copies beyond the first, by which the counts over all rows are too high.
    tried = rows.where("held <> ''").select("m", each).groupBy("term").agg(F.count("*").alias("n_held"), F.sum(F.col("m") - 1).alias("copies"))
    tried = tried.where(F.col("n_held") >= LEAST_BOTH).select(F.col("term").alias("_t"), F.xxhash64("term").alias("_th"), "n_held", "copies")

    beside = rows.where("held <> ''").select("id", F.explode("sets").alias("s"), "held").select("id", "s.*", "held")
    beside = beside.withColumn("groups", F.ceil(F.col("n_entity") / BESIDE))
    beside = beside.select("set", F.pmod(F.xxhash64("id"), "groups").alias("nth"), "n_entity", "exact", "groups", "held").repartition("set", "nth")
    both = beside.select("set", "nth", "n_entity", "exact", "groups", each)
    both = both.groupBy("set", "nth", "n_entity", "exact", "groups", "term").agg(F.count("*").alias("n"))
    both = both.where((F.col("groups") > 1) | (F.col("n") >= LEAST_BOTH))
    both = both.groupBy("set", "n_entity", "exact", "term").agg(F.sum("n").alias("n_both")).where(F.col("n_both") >= LEAST_BOTH)
    both = both.select("term", F.xxhash64("term").alias("th"), "n_entity", "exact", "n_both")
    both = both.join(tried, (F.col("term") == F.col("_t")) & (F.col("th") == F.col("_th"))).drop("th", "_t", "_th")
    near = cut(both.where(_gives(F.col("n_both"), F.col("n_held"), F.col("n_entity"), total, disclosure)))
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(near.select("term").distinct()))
    counted = near.join(term_counts(docs, bits), "term")
    gives = _gives(F.col("n_both"), F.col("n_term") - F.col("copies"), F.col("n_entity"), total, disclosure)
    return counted.where(gives).groupBy("term").agg(F.bool_or("exact").alias("exact"))


def places(docs: DataFrame, bits: Broadcast, text_col: str = "text") -> DataFrame:
    """Row, term and spans of the terms in the map, wherever they stand outside base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        mattering = Mattering(bits.value)
        for batch in batches:
            rows, terms, spans = [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                hits = mattering.of(text) if text else ()
                at: dict[str, list] = {}
                for term, s, e in free_terms(text, base_spans(text)) if hits else ():
                    if term in hits:
                        at.setdefault(term, []).append({"start": s, "end": e})
                rows += [r] * len(at)
                terms += at.keys()
                spans += at.values()
            if rows:
                out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays(out, names=["row", "term", "at"])

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    own = docs.select("row", F.col(f"`{text_col}`"))
    return own.mapInArrow(run, "row string, term string, at array<struct<start:int,end:int>>")


def _row(text_col: str) -> Column:
    """What equal texts have in common."""
    return F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))


def detect(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    disclosure: float = DISCLOSURE,
) -> DataFrame:
    """doc_id, base spans and spans of terms and hints of every row, with ``row``, a hash of the text."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), _row(text_col).alias("row"))
    found = cut(find(own, keep=["doc_id", "row"]).withColumn("id", F.monotonically_increasing_id()))
    terms = cut(disclosing(found, own, disclosure))
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(terms))
    kind = F.when(F.col("exact"), F.lit(TERM)).otherwise(F.lit(HINT))
    terms = terms.select(F.col("term").alias("_t"), F.xxhash64("term").alias("_h"), kind.alias("kind"))
    held = places(own, bits).withColumn("h", F.xxhash64("term"))
    extra = (
        held.join(terms, (F.col("term") == F.col("_t")) & (F.col("h") == F.col("_h")))
        .select("row", "kind", F.explode("at").alias("s"))
        .distinct()
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("kind", "s.start", "s.end"))).alias("terms"))
        .withColumnRenamed("row", "_row")
    )
    empty = F.array().cast(f"array<{_SPAN}>")
    # A very frequent text is one row on the right: its hash as second key lets the left be split.
    extra = extra.withColumn("_h", F.xxhash64("_row"))
    return (
        found.withColumn("h", F.xxhash64("row"))
        .join(extra, (F.col("row") == F.col("_row")) & (F.col("h") == F.col("_h")), "left")
        .select("doc_id", "row", "base", F.coalesce("terms", empty).alias("terms"))
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Terms vanish, other spans become their kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in spans):
        if start >= at:
            out.append(text[at:start] + ("" if kind == TERM else f"[{KINDS[kind].upper()}]"))
        at = max(at, -end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows given with personal data taken out of their texts."""
    found = detect(docs, id_col=id_col, text_col=text_col, **options)
    own, hit, held, clean = (unused(docs, n) for n in ("own_row", "hit_row", "held_spans", "clean_text"))
    spans = F.concat("base", "terms")
    # Rows without spans need no join; of equal texts one is enough.
    hits = found.where(F.size(spans) > 0).groupBy(F.col("row").alias(hit)).agg(F.first(spans).alias(held))
    hits = hits.withColumn(hit + "_h", F.xxhash64(hit))
    joined = docs.withColumn(own, _row(text_col)).withColumn(own + "_h", F.xxhash64(own))
    joined = joined.join(hits, (F.col(own) == F.col(hit)) & (F.col(own + "_h") == F.col(hit + "_h")), "left")

    def run(texts: pa.Array, held: pa.Array) -> list:
        rows = zip(texts.to_pylist(), held.to_pylist())
        return [[t if not h else redact(t, [(s["kind"], s["start"], s["end"]) for s in h]) for t, h in rows]]

    made = add_columns(joined, [text_col, held], f"{clean} string", run, keep=docs.columns)
    return made.withColumn(text_col, F.col(clean)).select(*[F.col(f"`{c}`") for c in docs.columns])
