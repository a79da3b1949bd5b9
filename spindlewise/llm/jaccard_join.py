"""All documents linked by a Jaccard similarity of word passages, by a token-group matrix. Exact at any size of group.

Tokens are hashes of five-word passages; a document is its set of tokens. Equal sets are one class. Classes are compared:

* Tokens are put in one order for all: those listed as frequent last, by their frequency, the others by hash. Two sets
  that are similar enough share a token among the first ``n - ceil(0.8 n) + 1`` of each, so only those are posted.
  The first shared token has a place in either set, and no more is shared than what stands from there on: a token only
  makes candidates of sets whose places leave room for the overlap that their sizes need.
* Where few classes share a posted token, its pairs of like size are compared directly.
* Where many do, each is first compared with one of them, that where the token has the foremost place: of copies with
  changes of their own it is the one they were made from. What links makes components. Classes of a component are
  similar documents: they are dealt to groups of about half of ``GROUP``, and the matrix stores each group's union of tokens.
  A class of another component that shares a posted token is a query: the overlap with the union bounds the overlap with
  every member, and only groups whose bound reaches the threshold are opened. Pairs inside a component need no
  comparison, so a large group of near copies costs its size, not its square.

The list of frequent tokens only shapes the order. It has a fixed length, and any list gives the same result.
Tokens have 48 bits in sets and 64 in class ids: at a billion documents a wrong match is a matter of chance below a
thousandth for each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewise.llm.common import broadcast_if_small, sliced, stored
from spindlewise.llm.graph import components

WORDS, SHARE = 5, (80, 100)
#: Lists of classes of one token up to SHORT are compared pair by pair. Tokens in HOT texts or more bypass the shuffle by
#: token. FREQUENT tokens at most are listed, none in fewer than SHORT texts. GROUP is the size of a group of classes.
SHORT, HOT, FREQUENT, GROUP = 16, 512, 400_000, 256
#: Keys (24 bytes each) of classes to compare that may be broadcast; more are joined by shuffling.
BROADCAST_IDS = 500_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class WordHash(dict):
    """64-bit hashes of words, remembered for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 200_000:
            self.clear()
        self[word] = value
        return value


def tokens_of(text: bytes, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit tokens of a text in UTF-8; of its letters A-Z only are put in lower case."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    span = min(WORDS, len(codes))
    with np.errstate(over="ignore"):
        mixed = sum((codes[k : len(codes) - span + 1 + k] * m for k, m in zip(range(span), _MULTIPLIERS)), np.uint64(span))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(mixed ^ (mixed >> np.uint64(32)))


def _pack(tokens: np.ndarray) -> bytes:
    """48-bit tokens, ascending, in six bytes each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _needed(n: int) -> int:
    """Tokens that a set similar to one of n tokens shares with it at least."""
    return -(-SHARE[0] * n // SHARE[1])


def _reach(n, place):
    """A set of n tokens that first shares the one at ``place`` is similar to sets of m tokens only if 80 m is no more than this."""
    return (SHARE[0] + SHARE[1]) * (n - place) - SHARE[0] * n


def linked(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SHARE[1] * both >= SHARE[0] * (n_a + n_b - both)


def texts_of(docs: DataFrame) -> DataFrame:
    """(text, doc_id, text_key) of every row; null is empty text.

    Tokens take more room than the texts they come from, so they are computed where they are needed and not stored.
    """
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), "doc_id", _text_key().alias("text_key"))


def _class(tokens: np.ndarray) -> int | None:
    """Id of a set of tokens; none of an empty one."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None


def _narrowed(tokens: np.ndarray) -> np.ndarray:
    return np.unique(tokens >> np.uint64(16))


def described(texts: DataFrame, slices: int) -> DataFrame:
    """Stored results of one pass over the texts, told apart by ``slice``.

    Where it is null, (doc_id, text_key, class, n) of a row; without words n is 0, class null. Elsewhere ``data`` holds token
    prefixes of a slice of their values, and in how many of a task's texts each is: each task counts its own and sends
    them compressed.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_key", "class", "n", "slice", "data"]

    def run(batches):
        held, size, like = [], 0, pa.int64()

        def send():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            which = (values.astype(np.uint64) * np.uint64(slices)) >> np.uint64(32)
            cuts = np.flatnonzero(np.diff(which)) + 1
            parts, each = np.split(values, cuts), np.split(counts, cuts)
            data = [zlib.compress(np.diff(v, prepend=np.uint32(0)).astype("<u4").tobytes() + c.astype("<u4").tobytes(), 1) for v, c in zip(parts, each)]
            at = [int(which[k]) for k in np.append(0, cuts)]
            none = [pa.nulls(len(at), t) for t in (like, pa.binary(), pa.int64(), pa.int32())]
            return pa.RecordBatch.from_arrays([*none, pa.array(at, pa.int32()), pa.array(data, pa.binary())], names=names)

        hashes = WordHash()
        for rows in sliced(batches, 0):
            like = rows.column(1).type
            found = [tokens_of(text, hashes) for text in rows.column(0).to_pylist()]
            columns = [rows.column(1), rows.column(2), pa.array([_class(t) for t in found], pa.int64()), pa.array([len(t) for t in found], pa.int32())]
            none = [pa.nulls(len(found), t) for t in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *none], names=names)
            for tokens in found:
                if len(tokens):
                    held.append((tokens >> np.uint64(32)).astype(np.uint32))
                    size += len(held[-1])
                    if size > 2_000_000:
                        yield send()
                        held, size = [], 0
        if held:
            yield send()

    schema = f"doc_id {kind}, text_key binary, class long, n int, slice int, data binary"
    return stored(texts.select("text", "doc_id", "text_key").mapInArrow(run, schema), "jaccard-documents")


def with_tokens(texts: DataFrame) -> DataFrame:
    """(class, n, tokens) of every row, the tokens packed."""

    def run(batches):
        hashes = WordHash()
        for rows in sliced(batches, 0):
            found = [tokens_of(text, hashes) for text in rows.column(0).to_pylist()]
            columns = [pa.array([_class(t) for t in found], pa.int64()), pa.array([len(t) for t in found], pa.int32())]
            packed = pa.array([_pack(_narrowed(t)) for t in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, packed], names=["class", "n", "tokens"])

    return texts.select("text").mapInArrow(run, "class long, n int, tokens binary")


def frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent 32-bit token prefixes, ascending, and in how many texts they are, from what tasks counted."""

    def total_of(group: pa.Table) -> pa.Table:
        values, counts = [], []
        for data in group.column("data").to_pylist():
            both = np.frombuffer(zlib.decompress(data), "<u4")
            values.append(np.cumsum(both[: len(both) // 2], dtype=np.uint32))
            counts.append(both[len(both) // 2 :])
        value, inverse = np.unique(np.concatenate(values), return_inverse=True)
        texts = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
        often = texts >= SHORT
        return pa.table({"value": pa.array(value[often].astype(np.int64)), "texts": pa.array(texts[often])})

    counts = counted.select("slice", "data").groupBy("slice").applyInArrow(total_of, "value long, texts long")
    top = counts.orderBy(F.desc("texts"), "value").limit(FREQUENT).toPandas().sort_values("value")
    return top["value"].to_numpy(np.uint64), top["texts"].to_numpy(np.int64)


def postings(texts: DataFrame, listed: tuple[np.ndarray, np.ndarray], total: int) -> DataFrame:
    """Stored (kind, a, b, token, n, place): pairs of classes to compare (kind 'pair') and postings of tokens that many
    classes share (kind 'long', class in a). ``place`` is the token's in its set, or the last that two bytes can name."""
    shared = texts.sparkSession.sparkContext.broadcast(listed)
    slices = max(48, total // 3_000_000)
    record = np.dtype([("token", "<u8"), ("class", "<i8"), ("n", "<i4"), ("place", "<u2")])
    schema = "slice int, hot boolean, data binary"

    def post(batches):
        values, often = shared.value
        hashes = WordHash()
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def send(entries: np.ndarray, hot: bool):
            place = entries["class"].view("<u8") >> np.uint64(16) if hot else entries["token"]
            which = ((place >> np.uint64(16)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)  # hot tokens are dealt by class
            order = np.lexsort((entries["token"], which))
            entries, which = entries[order], which[order]
            cuts = np.flatnonzero(np.diff(which)) + 1
            entries["token"] = np.diff(entries["token"], prepend=np.uint64(0))
            entries["token"][np.append(0, cuts)] = np.add.accumulate(entries["token"])[np.append(0, cuts)]  # each part starts anew
            data = [zlib.compress(b"".join(part[f].tobytes() for f in record.names), 1) for part in np.split(entries, cuts)]
            return pa.RecordBatch.from_arrays(
                [pa.array(which[np.append(0, cuts)].astype(np.int32)), pa.array([hot] * len(data)), pa.array(data, pa.binary())], names=["slice", "hot", "data"]
            )

        def flush():
            entries = np.concatenate(held)
            prefix = entries["token"] >> np.uint64(16)
            at = np.searchsorted(values, prefix)
            found = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == prefix) if len(values) else np.zeros(len(prefix), bool)
            hot = found & (often[np.minimum(at, len(values) - 1)] >= HOT) if len(values) else found
            for part, is_hot in ((entries[~hot], False), (entries[hot], True)):
                if len(part):
                    yield send(part, is_hot)

        for batch in sliced(batches, 0):
            for text in batch.column(0).to_pylist():
                whole = tokens_of(text, hashes)
                n, cls = len(whole), _class(whole)
                if not n or cls in seen:
                    continue
                if len(seen) < 200_000:  # copies met again are only dropped early; the receiver drops the others
                    seen.add(cls)
                tokens = _narrowed(whole)
                prefix = tokens >> np.uint64(16)
                at = np.minimum(np.searchsorted(values, prefix), max(len(values) - 1, 0))
                rank = np.where(values[at] == prefix, often[at], 0) if len(values) else np.zeros(len(tokens), np.int64)
                first = np.lexsort((tokens, rank))[: n - _needed(n) + 1]
                entry = np.empty(len(first), record)
                entry["token"], entry["class"], entry["n"] = tokens[first], cls, n
                entry["place"] = np.minimum(np.arange(len(first)), 0xFFFF)
                held.append(entry)
                size += len(entry)
                if size > 300_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def read(data: bytes) -> np.ndarray:
        raw = zlib.decompress(data)
        entries = np.empty(len(raw) // record.itemsize, record)
        at = 0
        for name in record.names:
            width = record[name].itemsize * len(entries)
            entries[name] = np.frombuffer(raw[at : at + width], record[name])
            at += width
        entries["token"] = np.cumsum(entries["token"])
        return entries

    out = "kind string, a long, b long, token long, n int, place int"
    columns = out.replace(" string", "").replace(" long", "").replace(" int", "").split(", ")
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    table = lambda *c: pa.table([pa.array(x, t) for x, t in zip(c, types)], names=columns)

    def long_rows(entries: np.ndarray):
        return ["long"] * len(entries), entries["class"], np.zeros(len(entries), np.int64), entries["token"].astype(np.int64), entries["n"], entries["place"].astype(np.int32)

    def meet(group: pa.Table) -> pa.Table:
        packed = list(zip(group.column("hot").to_pylist(), group.column("data").to_pylist()))
        many = [read(data) for hot, data in packed if hot]
        entries = np.concatenate([read(data) for hot, data in packed if not hot] or [np.empty(0, record)])
        entries = entries[np.lexsort((entries["class"], entries["n"], entries["token"]))]
        again = (entries["token"][1:] == entries["token"][:-1]) & (entries["class"][1:] == entries["class"][:-1])
        entries = entries[np.append(np.ones(min(1, len(entries)), bool), ~again)]
        first = np.ones(min(1, len(entries)), bool)
        starts = np.flatnonzero(np.append(first, entries["token"][1:] != entries["token"][:-1]))
        ends = np.append(starts[1:], len(entries))
        pairs = set()
        for start, end in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            if end - start > SHORT:
                many.append(entries[start:end])
                continue
            some = entries[start:end].tolist()
            for k, (_, a, n_a, p_a) in enumerate(some):
                most = _reach(n_a, p_a)
                for _, b, n_b, p_b in some[k + 1 :]:
                    if n_a < _needed(n_b) or most < SHARE[0] * n_b:
                        break
                    if _reach(n_b, p_b) >= SHARE[0] * n_a:
                        pairs.add((a, b) if a < b else (b, a))
        pairs = sorted(pairs)
        rest = long_rows(np.concatenate(many)) if many else ([],) * 6
        direct = (["pair"] * len(pairs), [a for a, _ in pairs], [b for _, b in pairs], [0] * len(pairs), [0] * len(pairs), [0] * len(pairs))
        return pa.concat_tables([table(*direct), table(*rest)])

    sent = texts.select("text").mapInArrow(post, schema)
    return stored(sent.groupBy("slice").applyInArrow(meet, out), "jaccard-candidates")


def _sets_of(texts: DataFrame, narrow: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored (class, n, tokens) for each of ``ids`` (class, stored and distinct), from one row of each class."""
    first = narrow.join(ids, "class").groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
    first = stored(first.select(F.col("r.doc_id").alias("_id"), F.col("r.text_key").alias("_key")), "jaccard-representatives")
    some = F.broadcast(first) if first.count() <= BROADCAST_IDS else first
    same = texts["doc_id"].eqNullSafe(some["_id"]) & (texts["text_key"] == some["_key"])
    return stored(with_tokens(texts.join(some, same, "left_semi")), "jaccard-classes")


def compared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""
    side = lambda k: classes.select(*(F.col(c).alias(f"{c}_{k}") for c in ("class", "n", "tokens")))
    a, b = side("a"), side("b")
    both = pairs.join(a, pairs["a"] == a["class_a"]).join(b, pairs["b"] == b["class_b"])

    def run(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            keep = [linked(_unpack(x), _unpack(y), m, n) for _, _, x, y, m, n in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "tokens_a", "tokens_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def group_links(many: DataFrame, membership: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between classes of different components that share a token of ``many`` (token, class, n, place): the matrix.

    ``membership`` (class, component) has every class of ``many``. Of two components the smaller one asks. A query and a
    group give one link at most, since a group's members are one component already. Queries meet unions first; the sets of
    a group move only to the queries that its union leaves room for.
    """
    sizes = membership.groupBy("component").agg(F.count("*").alias("size"))
    placed = (
        membership.join(sizes, "component")
        .withColumn("part", F.pmod(F.xxhash64("class"), F.ceil(F.col("size") / (GROUP // 2))))
        .withColumn("group", F.xxhash64("component", "part"))
    )
    placed = stored(placed.select("class", "component", "size", "group"), "jaccard-groups")
    at = many.withColumn("reach", _reach(F.col("n").cast("long"), F.col("place"))).join(placed, "class")
    open_tokens = (
        at.select("token", "component").distinct().groupBy("token").agg(F.count("*").alias("components")).where("components > 1").select("token")
    )
    at = at.join(stored(open_tokens, "jaccard-open"), "token", "left_semi")
    queries = at.select("token", F.col("class").alias("query"), F.col("n").alias("query_n"), F.col("reach").alias("query_reach"), F.col("component").alias("own"), F.col("size").alias("own_size"))
    groups = at.groupBy("token", "group", "component", "size").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("reach"))
    asks = F.expr("(own_size, own) < (size, component)")
    like = (F.col("least") * SHARE[0] <= F.col("query_n") * SHARE[1]) & (F.col("query_n") * SHARE[0] <= F.col("most") * SHARE[1])
    room = (F.col("query_reach") >= F.col("least") * SHARE[0]) & (F.col("reach") >= F.col("query_n") * SHARE[0])
    wanted = stored(queries.join(groups, "token").where(asks & like & room).select("query", "group").distinct(), "jaccard-queries")
    members = classes.join(placed.select("class", "group").join(wanted.select("group").distinct(), "group", "left_semi"), "class")

    def column(group: pa.Table) -> pa.Table:
        rows = group.column("tokens").to_pylist()
        union = np.unique(np.concatenate([_unpack(t) for t in rows]))
        lengths = np.array([len(t) for t in rows], "<i4").tobytes()
        return pa.table(
            {
                "group": [group.column("group")[0].as_py()],
                "union": pa.array([_pack(union)], pa.binary()),
                "classes": [group.column("class").to_pylist()],
                "ns": pa.array([group.column("n").to_pylist()], pa.list_(pa.int32())),
                "lengths": pa.array([lengths], pa.binary()),
                "sets": pa.array([b"".join(rows)], pa.binary()),
            }
        )

    matrix = members.groupBy("group").applyInArrow(column, "group long, union binary, classes array<long>, ns array<int>, lengths binary, sets binary")
    matrix = stored(matrix, "jaccard-matrix")
    asked = wanted.join(classes.withColumnRenamed("class", "query"), "query")

    def bound(batches):
        for batch in batches:
            keep = []
            for n, tokens, union, least in zip(*(batch.column(name).to_pylist() for name in ("n", "tokens", "union", "least"))):
                inside = len(np.intersect1d(_unpack(tokens), _unpack(union), assume_unique=True))
                # similar sets share (n + m) * share / (1 + share) tokens at least
                keep.append(inside * (SHARE[0] + SHARE[1]) >= SHARE[0] * (n + least))
            yield batch.select(["query", "group", "n", "tokens"]).filter(pa.array(keep, pa.bool_()))

    unions = matrix.select("group", "union", F.array_min("ns").alias("least"))
    kept = "query long, group long, n int, tokens binary"
    qualified = stored(asked.join(unions, "group").select("query", "group", "n", "tokens", "union", "least").mapInArrow(bound, kept), "jaccard-qualified")

    def answer(batches):
        for batch in batches:
            links = []
            for query, n, tokens, ids, ns, lengths, members in zip(*(c.to_pylist() for c in batch.columns)):
                own = _unpack(tokens)
                at = 0
                for cls, m, length in zip(ids, ns, np.frombuffer(lengths, "<i4")):
                    if m >= _needed(n) and n >= _needed(m) and linked(own, _unpack(members[at : at + length]), n, m):
                        links.append((query, cls))
                        break
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    opened = qualified.join(matrix.select("group", "classes", "ns", "lengths", "sets"), "group")
    return opened.select("query", "n", "tokens", "classes", "ns", "lengths", "sets").mapInArrow(answer, "a long, b long")


def joined(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id and component_id.

    Words are split at ASCII white space after A-Z are put in lower case. A document with fewer than five words has its
    whole sequence as its one token; null texts and texts without words have none, no class, and link with nothing:
    their component is their own id. ``component_id`` is the smallest doc_id that links reach; missing ids are passed over,
    and a component without any id has null. ``component`` names the component itself, by one of its classes. Repeated rows are of one class. Other columns are not read. An empty
    table gives no rows.
    """
    texts = texts_of(docs)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    both = described(texts, max(48, size // 12_000_000))
    narrow = both.where("slice is null").select("doc_id", "text_key", "class", "n")
    total = narrow.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = postings(texts, frequent(both.where("slice is not null")), total)
    many = stored(found.where("kind = 'long'").select("token", F.col("a").alias("class"), "n", "place").distinct(), "jaccard-long")
    pairs = stored(found.where("kind = 'pair'").select("a", "b").distinct(), "jaccard-pairs")
    ids = pairs.select(F.col("a").alias("class")).unionAll(pairs.select("b")).unionAll(many.select("class")).distinct()
    classes = _sets_of(texts, narrow, stored(ids, "jaccard-ids"))
    # one comparison for each class, with the smallest of those it meets: what links needs no further one inside
    band = F.floor(F.log("n") / F.log(F.lit(SHARE[1] / SHARE[0])))
    pivots = stored(many.groupBy("token", band.alias("band")).agg(F.min_by("class", F.struct(F.col("place") / F.col("n"), "class")).alias("pivot")), "jaccard-pivots")
    stars = many.withColumn("band", band).join(pivots, ["token", "band"]).where("class != pivot")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionAll(stars.select(F.col("pivot").alias("a"), F.col("class").alias("b")))
    first = stored(first.distinct(), "jaccard-first")
    links = stored(compared(first, classes), "jaccard-links")
    member = components(links)
    own = lambda k: member.select(F.col("node").alias(f"node_{k}"), F.col("component").alias(f"own_{k}"))
    apart = (
        pairs.join(own("a"), F.col("a") == F.col("node_a"), "left").join(own("b"), F.col("b") == F.col("node_b"), "left")
        .where(F.coalesce("own_a", "a") != F.coalesce("own_b", "b")).select("a", "b")
        .join(first, ["a", "b"], "left_anti")
    )
    extra = compared(stored(apart, "jaccard-apart"), classes)
    if not many.isEmpty():
        membership = many.select("class").distinct().join(member, F.col("class") == F.col("node"), "left").select("class", F.coalesce("component", "class").alias("component"))
        everyone = stored(membership.unionAll(member.select("node", "component")).distinct(), "jaccard-members")
        extra = extra.unionAll(group_links(many, everyone, classes))
    extra = stored(extra, "jaccard-links")
    if not extra.isEmpty():
        member = components(links.unionAll(extra))
    smallest = narrow.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    placed = smallest.join(member, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("component", "class").alias("component"))
    placed = stored(placed, "jaccard-placed")
    named = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("class", "component_id", "component")
    return narrow.join(named, "class", "left").select(
        "doc_id",
        "text_key",
        F.col("n").cast("long").alias("n_shingles"),
        F.col("class").alias("class_id"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "component",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each component the one with the smallest doc_id.

    Rows without words are all kept. Of rows that share the smallest id (a missing one counts as such) the one with the
    smallest class and text digest stays; of rows that share the text too, one.
    """
    rows = stored(joined(docs), "jaccard-rows")
    order = F.struct("doc_id", "class_id", "text_key")
    best = rows.where("component is not null").groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    of_several = rows.join(best, "component").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), (order == F.col("best")).alias("_stays"))
    decided = of_several.groupBy("_id", "_key", "_stays").agg(F.count("*").alias("_rows")).where("_rows > 1 or not _stays")
    decided = stored(decided, "jaccard-dropped")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (_text_key() == F.col("_key"))
    once = docs.join(broadcast_if_small(decided), same, "left_anti")
    repeated = decided.where("_stays")
    if repeated.isEmpty():
        return once
    again = docs.join(broadcast_if_small(repeated), same, "left_semi").withColumn("_key", _text_key())
    return once.unionAll(again.dropDuplicates(["doc_id", "_key"]).drop("_key"))


def _text_key() -> Column:
    """Digest that tells apart rows with one id."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
