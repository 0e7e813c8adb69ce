"""Near duplicates by BagMinHash: weighted MinHash signatures, bands, exact overlap.

A text is the multiset of its shingles of five words. For every shingle and every dyadic range
of its weight axis ([0,1), [1,2), [2,4), ...) a Poisson process with a rate of the range's length
runs over time; each of its points carries a place on the weight axis, a signature slot and a
64-bit name, all derived from the shingle alone. A text sees the points whose place lies below
its count of the shingle, and each slot keeps the name of its earliest point. Two slots are equal
with a probability of sum(min) / sum(max) of the counts, for any counts. Slots form bands; texts
that share a band are candidates and are verified by their real multiset overlap.

Candidates are not spread into all pairs of a band. The members of a band are compared with one
pivot and the close ones are linked. Members that are then still in different components, and share
enough shingles with other such texts at all, are compared with a hub, a member with few shingles of
its own that many of their bands have in common. What a text adds to its hub's shingles or lacks of
them is a set; if two texts reach the limit, their sets have at least (e_x + e_y) / 2 elements in
common, where e is the size of the set less (1 - s) / (1 + s) times the text's shingles for a limit
of s. So they share one of their rarest elements, early enough in both for the rest to suffice (a
prefix join), and only such pairs become candidates. In a family of copies with edits of their own
all shingles are common, but the differences are not. No pair of a band is lost by this. Before their
texts are read, candidates must have enough equal slots in one-byte sketches of the signatures (a true
pair fails with a chance below one in a million).

Null and empty texts are one class (equal texts); a text without any letter or digit has copies
only. Texts of fewer than five words are one shingle. Repeated rows and repeated or null ids each
get their row; the class id is the smallest id in the class.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.shared import drop_staged, free_name, mix, stage, word_batches

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 8
HUB_JUMPS = 2  # times that a hub is replaced by the best hub of its own bands
HUB_SIZE = 2  # a text is compared with hubs of up to so many times its shingles, others by all its shingles
STAR_ROUNDS = 2  # times that each text is compared with one of its candidates before all that are left are
HOT_TOKEN = 2000  # texts with one difference above which they are dealt to several tasks
HUB_ROWS = 64  # texts that are dealt to one copy of their hub's text
LEAD_ROUNDS = 2  # times that the texts of a prefix are compared with one of them before pairs are formed
TOKENS_A_BATCH = 1 << 20
SKETCH_MARGIN = 0.12  # a pair this far below the limit by its sketches (5 sigma) is not compared by text


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int = SHINGLE_WORDS):
    """Shingle hashes of consecutive words and the index of their text."""
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    n = len(hashes) - k + 1
    if n > 0:
        run = np.zeros(n, np.uint64)
        for j in range(k):
            run *= np.uint64(0x100000001B3)
            run += hashes[j : j + n]
        whole = np.arange(n) + k <= ends[text[:n]]
        out, owner = mix(run[whole]), text[:n][whole]
    else:
        out, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = []
        for i in short:
            h = np.uint64(counts[i])
            for w in hashes[ends[i] - counts[i] : ends[i]]:
                h = mix(np.array([h, w], np.uint64).sum(keepdims=True))[0]
            extra.append(h)
        out = np.concatenate([out, np.array(extra, np.uint64)])
        owner = np.concatenate([owner, short])
    return out, owner


def counted(out: np.ndarray, owner: np.ndarray):
    """Distinct shingles of each text with their counts."""
    key = mix(out + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, weight = np.unique(key, return_index=True, return_counts=True)
    return out[first], owner[first], weight


def signatures(out, owner, weight, n_texts: int, slots: int) -> np.ndarray:
    """One row of slot names per text; texts without shingles keep zeros."""
    names = np.zeros(n_texts * slots, np.uint64)
    best = np.full(n_texts * slots, np.inf)
    total = np.bincount(owner, weight, n_texts)
    has = total > 0
    # the time until which points are drawn; with this many points a slot seldom stays open
    until = np.zeros(n_texts)
    until[has] = slots * (np.log(slots) + 2) / total[has]
    todo = has.copy()
    levels = 1 + np.ceil(np.log2(weight)).astype(np.int64)  # dyadic ranges that begin below the weight
    elem = np.repeat(np.arange(len(out)), levels)
    level = np.arange(len(elem)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    rate = np.where(level == 0, 1, low).astype(np.float64)
    seed = mix(out[elem] + level.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    while todo.any():
        use = np.flatnonzero(todo[owner[elem]])
        state, own, lo, ra = seed[use], owner[elem[use]], low[use], rate[use]
        cap = weight[elem[use]]
        when = np.zeros(len(use))
        idx, x, name = [], [], []
        while len(state):
            state = mix(state + np.uint64(0xA0761D6478BD642F))
            draw = (state >> np.uint64(11)).astype(np.float64)
            draw += 0.5
            draw *= 2.0**-53
            when = when - np.log(draw) / ra
            alive = when <= until[own]
            state, when, own, lo, ra, cap = (a[alive] for a in (state, when, own, lo, ra, cap))
            more = mix(state ^ np.uint64(0xE7037ED1A0B428DB))
            place = lo + ((more >> np.uint64(40)).astype(np.float64) * 2.0**-24 * ra).astype(np.int64)
            slot = (more & np.uint64(0xFFFFFFFF)) % np.uint64(slots)
            seen = place < cap
            idx.append((own * slots + slot.astype(np.int64))[seen])
            x.append(when[seen])
            name.append(mix(more)[seen])
        idx, x, name = np.concatenate(idx), np.concatenate(x), np.concatenate(name)
        np.minimum.at(best, idx, x)
        first = x == best[idx]
        names[idx[first]] = name[first]
        open_ = np.isinf(best.reshape(n_texts, slots)).any(axis=1) & has
        again = open_ & todo
        best.reshape(n_texts, slots)[again] = np.inf
        until[again] *= 2
        todo = again
    return names.reshape(n_texts, slots)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), np.uint64)
    for j in range(rows):
        keys = mix(keys + sig[:, j::rows][:, :bands])
    return mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)


def _band_batches(batches, bands: int, rows: int):
    for batch in batches:
        names = batch.schema.names
        cols = {c: batch.column(i) for i, c in enumerate(names)}
        texts = cols.pop("text").to_pylist()
        n_shingles = np.zeros(len(texts), np.int64)
        keys = np.zeros((len(texts), bands), np.int64)
        sketch = np.zeros((len(texts), bands * rows), np.uint8)
        for at, hashes, counts in word_batches(texts):
            out, owner, weight = counted(*shingles(hashes, counts))
            sig = signatures(out, owner, weight, len(counts), bands * rows)
            to = at + len(counts)
            keys[at:to] = band_keys(sig, bands, rows)
            sketch[at:to] = sig >> np.uint64(56)
            n_shingles[at:to] = np.bincount(owner, weight, len(counts))
        offsets = np.concatenate(([0], np.cumsum(np.where(n_shingles > 0, bands, 0)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, pa.array(keys[n_shingles > 0].ravel()))
        data = [cols["id"], cols["digest"], lists, pa.array([s.tobytes() for s in sketch], pa.binary()), pa.array(n_shingles)]
        yield pa.RecordBatch.from_arrays(data, ["id", "digest", "bands", "sketch", "n_shingles"])


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text in order, with their counts."""
    out, _ = shingles(*_words(text or ""))
    return np.unique(out, return_counts=True)


def _overlap(a: str, b: str) -> float:
    (ha, ca), (hb, cb) = _counts(a), _counts(b)
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = np.minimum(ca[i], cb[j]).sum()
    return both / max(1, ca.sum() + cb.sum() - both)


def difference(a, b) -> np.ndarray:
    """The set of what multiset ``a`` has more or less than ``b``: a name for each shingle, occurrence and direction."""
    names = np.union1d(a[0], b[0])
    has = np.zeros((2, len(names)), np.int64)
    for row, (hashes, counts) in zip(has, (a, b), strict=True):
        row[np.searchsorted(names, hashes)] = counts
    size = np.abs(has[0] - has[1])
    place = np.arange(size.sum()) + np.repeat(has.min(axis=0) - np.cumsum(size) + size, size)
    lacks = np.repeat(has[0] < has[1], size)
    return mix(np.repeat(names, size) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + lacks * np.uint64(0xC2B2AE3D27D4EB4F))


def _difference_batches(batches):
    """(digest, hub, tokens): how each text differs from its hub's; without a hub all its shingles."""
    last, base = None, _counts(None)
    for batch in batches:
        digests, hubs, texts, hub_texts = (batch.column(i) for i in range(4))
        held, start, size = [], 0, 0
        for i, (hub, text, hub_text) in enumerate(zip(hubs.to_pylist(), texts, hub_texts, strict=True)):
            if hub != last:
                last, base = hub, _counts(hub_text.as_py())
            held.append(difference(_counts(text.as_py()), base))
            size += len(held[-1])
            if size > TOKENS_A_BATCH or i + 1 == len(texts):
                offsets = np.concatenate(([0], np.cumsum([len(t) for t in held]))).astype(np.int32)
                tokens = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(held).view(np.int64)))
                yield pa.RecordBatch.from_arrays([digests[start : i + 1], hubs[start : i + 1], tokens], ["digest", "hub", "tokens"])
                held, start, size = [], i + 1, 0


def _words(text: str):
    parts = [(h, c) for _, h, c in word_batches([text])]
    return parts[0]


def _verify(batches, similarity: float):
    for batch in batches:
        a, b, ta, tb = (batch.column(i) for i in range(4))
        sim = [_overlap(x, y) for x, y in zip(ta.to_pylist(), tb.to_pylist(), strict=True)]
        keep = pa.array([s >= similarity for s in sim])
        yield pa.RecordBatch.from_arrays([a, b], ["u", "v"]).filter(keep)


def _alike(batches, least: float):
    """Pairs whose sketches agree in at least the given share of slots."""
    for batch in batches:
        u, v = batch.column("u"), batch.column("v")
        sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(u), -1) if len(u) else np.zeros((0, 1)) for c in ("su", "sv")]
        keep = (sides[0] == sides[1]).mean(axis=1) >= least
        yield pa.RecordBatch.from_arrays([u, v], ["u", "v"]).filter(pa.array(keep))


def _shingle_batches(batches):
    """(shingle, digest, weight): the distinct shingles of each text with their counts."""
    for batch in batches:
        digests = batch.column("digest")
        for at, hashes, counts in word_batches(batch.column("text").to_pylist()):
            out, owner, weight = counted(*shingles(hashes, counts))
            data = [pa.array(out.view(np.int64)), digests.take(pa.array(owner + at)), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(data, ["shingle", "digest", "weight"])


def unshared(texts: DataFrame) -> DataFrame:
    """(digest, alone): how many shingles of a text no other of the texts (digest, text) has."""
    all_shingles = texts.select("digest", "text").mapInArrow(_shingle_batches, "shingle bigint, digest binary, weight bigint")
    once = all_shingles.groupBy("shingle").agg(F.count("*").alias("n"), F.first("digest").alias("digest"), F.first("weight").alias("weight"))
    return once.filter("n = 1").groupBy("digest").agg(F.sum("weight").alias("alone"))


def open_members(band: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of bands that hold several components, with their component."""
    found = labels.select(F.col("node").alias("digest"), F.col("label").alias("comp"))
    held = band.join(found, "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    held = stage(held, "held")
    several = held.groupBy("band").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("band")
    out = stage(held.join(several, "band"), "open")
    drop_staged(held)
    return out


def spokes(members: DataFrame, similarity: float) -> DataFrame:
    """(digest, n, hub, hub_n): the hubs of each member; texts that share a band share a hub.

    The hub of a band is its member with the smallest share of shingles of its own, then the best
    hub of that member's bands. Members far smaller than their hub have the empty hub; sizes in
    between have both, so that no pair which can reach the similarity is parted.
    """
    rank = F.struct((1 - F.col("shared") / F.col("n_shingles")).alias("own"), F.col("digest").alias("hub"), F.col("n_shingles").alias("hub_n"))
    lead = members.groupBy("band").agg(F.min(rank).alias("lead"))
    best = stage(members.join(lead, "band").groupBy("digest").agg(F.min("lead").alias("up")), "best")
    up = best.withColumnRenamed("digest", "at")
    for _ in range(HUB_JUMPS):
        lead = lead.join(up, F.col("lead.hub") == F.col("at")).select("band", F.col("up").alias("lead"))
    of = members.join(lead, "band").select("digest", F.col("n_shingles").alias("n"), "lead.hub", "lead.hub_n").distinct()
    of = stage(of, "hubs")
    drop_staged(best)
    near = of.filter((F.col("hub") != F.col("digest")) & (F.col("hub_n") <= HUB_SIZE * F.col("n")))
    far = of.filter(F.col("hub_n") > HUB_SIZE * similarity * F.col("n")).select("digest", "n").distinct()
    return near.union(far.select("digest", "n", F.lit(b"").alias("hub"), F.lit(0).cast("long").alias("hub_n")))


def prefixes(at: DataFrame) -> DataFrame:
    """The tokens (hub, token, digest, comp, outside, e, rest, salts) of which close pairs share one, by their differences from one hub.

    at: (digest, hub, comp, outside, d, e, tokens): d is the number of tokens, e is d less the part
    that sizes allow; outside tells members that are not in their hub's component.
    """
    least = at.groupBy("hub").agg(F.min("e").alias("e_any"), F.min(F.when(F.col("outside"), F.col("e"))).alias("e_out"))
    e_other = F.when(F.col("outside"), F.col("e_any")).otherwise(F.col("e_out"))
    # of each pair one member is outside; the common tokens that a member needs with any partner
    need = F.greatest(F.lit(1), F.ceil((F.col("e") + e_other) / 2 - 1e-6))
    at = at.join(least.filter("e_out is not null"), "hub").withColumn("need", need).filter("d >= need").drop("e_any", "e_out")
    rows = stage(at.withColumn("token", F.explode("tokens")).drop("tokens"), "tokens")
    common = rows.groupBy("hub", "token").agg(F.count("*").alias("n"), F.max("outside").alias("any")).filter("n > 1 and any").drop("any")
    held = rows.join(common, ["hub", "token"])
    # tokens that nobody shares come first in the order and are counted only
    of_text = Window.partitionBy("hub", "digest")
    place = F.row_number().over(of_text.orderBy("n", "token")) - 1 + F.col("d") - F.count("*").over(of_text)
    held = held.withColumn("rest", F.col("d") - place).filter("rest >= need")
    salts = F.floor(F.col("n") / HOT_TOKEN).cast("int")
    held = held.withColumn("salts", salts)
    held = held.select("hub", "token", "digest", "comp", "outside", "e", "rest", "salts")
    out = stage(held, "prefixes")
    drop_staged(rows)
    return out


def relabelled(held: DataFrame, labels: DataFrame) -> DataFrame:
    """The prefixes with the components of today; tokens of one component only are left out."""
    now = labels.select(F.col("node").alias("digest"), F.col("label").alias("now"))
    held = held.join(now, "digest", "left").withColumn("comp", F.coalesce("now", "comp")).drop("now")
    several = held.groupBy("hub", "token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("hub", "token")
    return stage(held.join(several, ["hub", "token"], "left_semi"), "prefixes")


def lead_pairs(held: DataFrame, number: int) -> DataFrame:
    """Pairs (u, v) of the texts of each token with one text of it, another one for each number.

    As many as there are prefixes at most; in a cluster of close texts they link what would
    otherwise be all its pairs.
    """
    rank = F.struct(F.xxhash64("digest", F.lit(number)).alias("draw"), F.col("digest").alias("lead"), F.col("comp").alias("lead_comp"))
    lead = held.groupBy("hub", "token").agg(F.min(rank).alias("m"), F.first("salts").alias("salts"))
    lead = lead.select("hub", "token", "m.lead", "m.lead_comp", F.explode(F.sequence(F.lit(0), "salts")).alias("salt"))
    dealt = held.withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("salts") + 1).cast("int"))
    pairs = dealt.join(lead, ["hub", "token", "salt"]).filter("comp != lead_comp")
    pairs = pairs.select(F.least("digest", "lead").alias("u"), F.greatest("digest", "lead").alias("v"))
    return stage(pairs.distinct(), "leads")


def prefix_pairs(held: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components that may reach the similarity and share a token of their prefixes."""
    one = held.filter("outside").withColumn("salt", F.explode(F.sequence(F.lit(0), "salts"))).alias("x")
    two = held.withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("salts") + 1).cast("int")).alias("y")
    key = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.salt") == F.col("y.salt"))
    once = ~F.col("y.outside") | (F.col("x.digest") < F.col("y.digest"))
    enough = F.least("x.rest", "y.rest") >= (F.col("x.e") + F.col("y.e")) / 2 - 1e-6
    pairs = one.join(two, key & (F.col("x.comp") != F.col("y.comp")) & once & enough)
    pairs = stage(pairs.select(F.least("x.digest", "y.digest").alias("u"), F.greatest("x.digest", "y.digest").alias("v")).distinct(), "pairs")
    return pairs


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component; links are (u, v).

    Every round takes the smallest label among the neighbours and then the label of that label, so a
    path of length n closes in about log n rounds. Each round's table is written out.
    """
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label"))
    labels = stage(labels, "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        step = stage(step, "labels")
        changed = step.filter(F.col("old") != F.col("label")).limit(1).count()
        drop_staged(labels)
        labels = step.drop("old")
        if not changed:
            return labels


def by_label(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(u, v, cu, cv): the pairs whose texts are in different components, with these."""
    for side in "uv":
        known = labels.select(F.col("node").alias(side), F.col("label").alias("c" + side))
        pairs = pairs.join(known, side, "left").withColumn("c" + side, F.coalesce("c" + side, side))
    return pairs.filter("cu != cv").select("u", "v", "cu", "cv")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links, which join whole components."""
    between = stage(by_label(links, labels).select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct(), "between")
    joined = components(between)
    top = joined.select(F.col("node").alias("label"), F.col("label").alias("top"))
    moved = labels.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    out = stage(moved.union(joined.join(labels, "node", "left_anti")), "labels")
    drop_staged(between, joined, labels)
    return out


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(id, digest, class_id, class_digest, class_size) for each input row, id in ``id_col``'s type.

    ``digest`` identifies the text; ``class_digest`` the class. ``class_size`` counts rows.
    """
    rows_in = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows_in = rows_in.select("id", F.unhex(F.md5("text")).alias("digest"), "text")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, digest binary, bands array<bigint>, sketch binary, n_shingles bigint"
    hashed = stage(rows_in.mapInArrow(partial(_band_batches, bands=bands, rows=rows), schema), "bands")
    facts = [F.first(c).alias(c) for c in ("bands", "sketch", "n_shingles")]
    nodes = stage(hashed.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"), *facts), "nodes")

    # members of the bands that several texts share, each with the band's first pivot: its smallest digest
    in_band = nodes.select("digest", "n_shingles", F.explode("bands").alias("band"))
    first_pivot = in_band.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("digest", "n_shingles")).alias("p"))
    first_pivot = first_pivot.filter("n > 1").select("band", F.col("p.digest").alias("pivot"), F.col("p.n_shingles").alias("pivot_n"))
    band = stage(in_band.join(first_pivot, "band"), "candidates")
    wanted = nodes.join(band.select("digest").distinct(), "digest", "left_semi").select("digest", "rep", "sketch")
    same = (F.col("a.digest") == F.col("b.digest")) & F.col("a.rep").eqNullSafe(F.col("b.rep"))
    texts = rows_in.withColumnRenamed("id", "rep").alias("a").join(wanted.alias("b"), same).select("a.digest", "text", "sketch")
    texts = stage(texts.dropDuplicates(["digest"]), "texts")

    def close_ones(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) whose texts reach the similarity."""
        for side in "uv":
            pairs = pairs.join(texts.select(F.col("digest").alias(side), F.col("sketch").alias("s" + side)), side)
        alike = pairs.mapInArrow(partial(_alike, least=similarity - SKETCH_MARGIN), "u binary, v binary")
        for side in "uv":
            alike = alike.join(texts.select(F.col("digest").alias(side), F.col("text").alias("t" + side)), side)
        alike = alike.select("u", "v", "tu", "tv")
        return stage(alike.mapInArrow(partial(_verify, similarity=similarity), "u binary, v binary"), "close")

    with_pivot = (F.col("digest") != F.col("pivot")) & (F.least("n_shingles", "pivot_n") >= similarity * F.greatest("n_shingles", "pivot_n"))
    pairs = stage(band.filter(with_pivot).select(F.col("pivot").alias("u"), F.col("digest").alias("v")).distinct(), "pairs")
    links = close_ones(pairs)
    labels = components(links)
    band = band.select("band", "digest", "n_shingles")
    members = open_members(band, labels)
    # shingles of no other open text are in no overlap
    alone = unshared(texts.join(members.select("digest").distinct(), "digest", "left_semi"))
    shared = members.select("digest", "n_shingles").distinct().join(alone, "digest", "left")
    shared = shared.select("digest", (F.col("n_shingles") - F.coalesce("alone", F.lit(0))).alias("shared"), "n_shingles")
    shared = stage(shared.filter(F.col("shared") >= similarity * F.col("n_shingles")).drop("n_shingles"), "shared")
    drop_staged(members)
    members = open_members(band.join(shared, "digest"), labels)

    of = stage(spokes(members, similarity), "spokes")
    # a hub may be that of a third of all texts: its text is given to several tasks
    copies = of.groupBy("hub").agg(F.floor(F.count("*") / HUB_ROWS).cast("int").alias("copies"))
    dealt = of.select("digest", "hub").join(copies, "hub").select("digest", "hub", F.pmod(F.xxhash64("digest"), F.col("copies") + 1).cast("int").alias("copy"))
    compared = dealt.join(texts.select("digest", "text"), "digest")
    hub_text = copies.join(texts.select(F.col("digest").alias("hub"), F.col("text").alias("hub_text")), "hub", "left")
    hub_text = hub_text.withColumn("copy", F.explode(F.sequence(F.lit(0), "copies"))).drop("copies")
    compared = compared.join(hub_text, ["hub", "copy"], "left").select("digest", "hub", "text", "hub_text")
    compared = compared.mapInArrow(_difference_batches, "digest binary, hub binary, tokens array<bigint>")
    differs = stage(compared.join(of, ["digest", "hub"]).withColumn("d", F.size("tokens")), "differences")
    both = F.col("n") + F.col("hub_n")
    linked = (F.length("hub") > 0) & ((both - F.col("d")) / (both + F.col("d")) >= similarity)
    labels = merged(labels, differs.filter(linked).select(F.col("hub").alias("u"), F.col("digest").alias("v")))
    comp = labels.select(F.col("node").alias("digest"), F.col("label").alias("comp"))
    hub_comp = comp.select(F.col("digest").alias("hub"), F.col("comp").alias("hub_comp"))
    at = differs.join(comp, "digest", "left").join(hub_comp, "hub", "left")
    at = at.withColumn("comp", F.coalesce("comp", "digest")).withColumn("outside", F.col("comp") != F.coalesce("hub_comp", "hub"))
    at = at.select("digest", "hub", "comp", "outside", "d", (F.col("d") - (1 - similarity) / (1 + similarity) * F.col("n")).alias("e"), "tokens")
    held = relabelled(prefixes(at), labels)
    for number in range(LEAD_ROUNDS):
        leads = lead_pairs(held, number)
        labels = merged(labels, close_ones(leads))
        left = relabelled(held, labels)
        drop_staged(leads, held)
        held = left
    pairs = prefix_pairs(held)
    drop_staged(held)
    # nearly all of these are close: one pair of each text first, then those that are still apart
    for _ in range(STAR_ROUNDS):
        ends = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star = ends.groupBy("u").agg(F.min("v").alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        star = stage(star.distinct(), "star")
        labels = merged(labels, close_ones(star))
        rest = by_label(pairs.select("u", "v"), labels).select("u", "v").join(star, ["u", "v"], "left_anti")
        rest = stage(rest, "pairs")
        drop_staged(pairs, star)
        pairs = rest
    labels = merged(labels, close_ones(pairs))
    drop_staged(members, of, differs, pairs)

    label = labels.select(F.col("node").alias("digest"), "label")
    classed = nodes.select("digest", "rep", "n").join(label, "digest", "left")
    classed = classed.select("digest", "rep", "n", F.coalesce("label", "digest").alias("class_digest"))
    tops = classed.groupBy("class_digest").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size"))
    by_text = classed.select("digest", "class_digest").join(tops, "class_digest")
    return hashed.select("id", "digest").join(by_text, "digest").select("id", "digest", "class_id", "class_digest", "class_size")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, all columns unchanged.

    It is the row with the smallest id (then the smallest digest); of rows equal in both, any one.
    """
    classes = near_duplicates(docs, id_col, text_col)
    first = F.min(F.struct(F.col("id").isNull(), "id", "digest")).alias("m")
    name, keep_id, keep_digest = (free_name(docs, c) for c in ("_digest", "_keep_id", "_keep_digest"))
    keep = classes.groupBy("class_digest").agg(first).select(F.col("m.id").alias(keep_id), F.col("m.digest").alias(keep_digest))
    keep = stage(keep, "keep")
    held = docs.withColumn(name, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    stays = (F.col(name) == F.col(keep_digest)) & F.col(id_col).eqNullSafe(F.col(keep_id))
    held = held.join(keep, stays, "left_semi")
    return held.dropDuplicates([name, id_col]).drop(name)
