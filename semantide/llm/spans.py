"""Long exact spans shared between records, by level-wise doubling.

Records with equal texts are one class from the start and only one of them is looked at.

The first level looks at windows of half the wanted length. Of these only the
anchors are kept: in every stretch of ``min_len`` code points the window with
the least hash (leftmost on ties). Equal stretches choose equal anchors, so a
shared stretch always shows as an anchor that two texts have, while about two
windows in a hundred travel. Anchors that only one text has are dropped; what is
left is extended to twice the length by looking at ``min_len / 2`` code points on
either side: a stretch of ``min_len`` must lie within that. From the starts of the stretches
found so, ``longest`` goes on doubling: windows repeated at one length are hashed
at twice that length, until no candidates survive, and the last level is narrowed down
to the exact length.

Texts that are equal around an anchor are a class of that anchor. Classes of an anchor are compared pairwise while
there are few of them; an anchor with many classes is expanded by shift instead, which is linear in
the number of classes. Pairs are written where a common stretch begins: records
that agree around the anchor before, or around the next, have met there. So a pair of long equal texts is
written once and not at each anchor.

Around anchors texts are compared by themselves or by 128-bit digests of them; the window of an anchor by the two 64-bit hashes that find and confirm it.

Defined results: null texts and texts shorter than ``min_len`` share nothing; repeats
inside one record do not count; a stretch is compared by code points, unnormalised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semantide.sources.shared import materialise

#: Code points hashed at once; also the length at which a text is cut into overlapping pieces.
CHUNK = 1 << 18
#: Anchors with more classes than this are expanded by shift.
PAIRWISE_CLASSES = 64
#: Parts into which a range of lengths is cut at each step towards the exact length.
RADIX = 16

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_NEVER = np.iinfo(np.uint64).max


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n + 1, np.uint64(_BASE))
        down = np.full(n + 1, np.uint64(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def _window_hashes(points: np.ndarray, length: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """64-bit hash of each window of ``length`` values."""
    n = len(points)
    with np.errstate(over="ignore"):
        x = points.astype(np.uint64) * _MULT
        x ^= x >> np.uint64(29)
        x *= up[:n]
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(x, out=sums[1:])
        h = sums[length:] - sums[:-length]
        h *= down[: n - length + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
    return h


def _sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` successive keys."""
    n = len(keys)
    pad = -n % width
    blocks = np.concatenate([keys, np.full(pad, _NEVER, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _anchors_of(pieces: list[tuple[int, int, np.ndarray]], half: int, powers: tuple[np.ndarray, np.ndarray]):
    """(record, position, hash) of the anchors of some pieces of texts."""
    points = np.concatenate([p for _, _, p in pieces])
    lens = np.array([len(p) for _, _, p in pieces])
    ends = np.cumsum(lens)
    starts = ends - lens
    n = len(points)
    h = _window_hashes(points, half, *powers)
    bits = np.uint64(max(1, int(n).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    where = np.arange(len(h), dtype=np.uint64)
    keys = (h & ~mask) | where
    width = half + 1
    if len(keys) < width:
        return None
    least = _sliding_argmin(keys, width)
    # A stretch counts where it lies in one piece.
    inside = np.zeros(n + 1, np.int32)
    ok = lens >= 2 * half
    np.add.at(inside, starts[ok], 1)
    np.add.at(inside, ends[ok] - 2 * half + 1, -1)
    least = least[np.cumsum(inside)[: len(least)] > 0]
    if not len(least):
        return None
    chosen = (least[np.flatnonzero(np.r_[True, least[1:] != least[:-1]])] & mask).astype(np.int64)
    piece = np.searchsorted(ends, chosen, side="right")
    rows = np.array([r for r, _, _ in pieces])[piece]
    offset = np.array([o for _, o, _ in pieces])[piece]
    return rows, chosen - starts[piece] + offset, h[chosen].view(np.int64)


def _anchor_mapper(half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = 2 * half
        powers = _powers(2 * CHUNK + full)
        for batch in batches:
            ids = batch.column(0)
            pieces: list[tuple[int, int, np.ndarray]] = []
            size = 0

            def flush():
                found = _anchors_of(pieces, half, powers) if pieces else None
                pieces.clear()
                if found is not None:
                    rows, pos, h = found
                    order = np.lexsort((h, rows))
                    fresh = np.zeros(len(h), np.int32)
                    fresh[order] = np.r_[True, (np.diff(rows[order]) != 0) | (h[order][1:] != h[order][:-1])]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows)), pa.array(pos, pa.int64()), pa.array(h, pa.int64()), pa.array(fresh)],
                        ["id", "pos", "h", "fresh"],
                    )

            for row, text in enumerate(batch.column(1).to_pylist()):
                if text is None or len(text) < full:
                    continue
                for at in range(0, len(text) - full + 1, CHUNK):
                    part = text[at : at + CHUNK + full - 1]
                    pieces.append((row, at, np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)))
                    size += len(part)
                    if size >= CHUNK:
                        yield from flush()
                        size = 0
            yield from flush()

    return run


def _digest(*parts: str) -> bytes:
    return xxhash.xxh3_128_digest("\0".join(parts).encode("utf-8", "surrogatepass"))


def _context_mapper(half: int):
    """For each anchor what surrounds it, its class, and the classes of the anchors before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, places = (batch.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            for i, text, at in zip(ids, texts, places):
                around = []
                for p, h in sorted((x["pos"], x["h"]) for x in at):
                    left, mid, right = text[max(0, p - half) : p][::-1], text[p : p + half], text[p + half : p + 2 * half]
                    around.append((p, h, left, _signed(xxhash.xxh3_64_intdigest(mid.encode("utf-8", "surrogatepass"))), right, _digest(left, mid, right)))
                own = _digest("record", str(i))
                ks = [own, *(x[5] for x in around), own]
                out += [(i, *x, before, after) for x, before, after in zip(around, ks, ks[2:])]
                if len(out) > 20000:
                    yield _context_batch(out, batch.schema.field(0).type)
                    out = []
            if out:
                yield _context_batch(out, batch.schema.field(0).type)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_CONTEXT = "pos long, h long, l string, m long, r string, k binary, prev binary, next binary"


def _context_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
    names = ["id", *(c.split()[0] for c in _CONTEXT.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _common_prefix(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the common prefix of each pair."""
    if not a:
        return np.zeros(0, np.int32)
    width = max(1, max(map(len, a)), max(map(len, b)))

    def grid(x: list[str], fill: int) -> np.ndarray:
        lens = np.array([len(s) for s in x])
        flat = np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32)
        g = np.full((len(x), width), fill, np.uint32)
        g[np.arange(width) < lens[:, None]] = flat
        return g

    same = grid(a, 0xFFFFFFFF) == grid(b, 0xFFFFFFFE)
    return np.where(same.all(axis=1), width, same.argmin(axis=1)).astype(np.int32)


def _extend_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, class a, class b, common left part, common right part) of pairs of classes with equal windows."""
    for batch in batches:
        la, ma, ra, lb, mb, rb = (batch.column(i).to_pylist() for i in range(3, 9))
        left, right = _common_prefix(la, lb), _common_prefix(ra, rb)
        same = np.fromiter((x == y for x, y in zip(ma, mb)), bool, len(ma))
        rows = pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [pa.array(left), pa.array(right)], ["h", "ka", "kb", "left", "right"])
        yield rows.filter(pa.array(same))


def _level_mapper(length: int):
    """For each start the digests of the windows of ``length``, twice ``length`` and so on to the end of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, levels = [], [], []
            for row, (text, at) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                points = memoryview(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint8))
                for start in at:
                    size, found = length, []
                    while start + size <= len(text):
                        found.append(xxhash.xxh3_128_digest(points[4 * start : 4 * (start + size)]))
                        size *= 2
                    ids.append(row)
                    starts.append(start)
                    levels.append(found)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(ids, pa.int32())), pa.array(starts, pa.int64()), pa.array(levels, pa.list_(pa.binary()))], ["id", "start", "levels"]
                )

    return run


def _narrow_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a group of equal windows the digests of ``RADIX - 1`` extensions, and of none."""
    for batch in batches:
        rows, out = [], []
        for row, (text, at) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            points = memoryview(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint8))
            for x in at:
                begin, step = x["start"] + x["size"], -(-x["room"] // RADIX)
                for i in range(RADIX):
                    if i and (i * step >= x["room"] or begin + i * step > len(text)):
                        break
                    more = points[4 * begin : 4 * (begin + i * step)]
                    rows.append(row)
                    out.append((x["g"], x["start"], x["size"] + i * step, step, x["needy"], i, xxhash.xxh3_128_digest(more)))
        if rows:
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32()))] + [pa.array(c, t) for c, t in zip(zip(*out), types)], ["id", "g", "start", "size", "room", "needy", "i", "w"]
            )


class SharedSpans:
    """Shared stretches of ``min_len`` or more code points; see the module's text.

    ``df`` has the unique key ``id_col`` and the text ``text_col``; other columns are ignored.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, min_len: int = 200):
        if min_len < 4 or min_len % 2:
            raise ValueError("min_len must be even and at least 4")
        self.half = half = min_len // 2
        texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") >= min_len)
        self.id_type = texts.schema["id"].dataType.simpleString()
        # Classes of equal texts; what is joined later is a table of known size.
        keys = texts.select("id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.length("text").alias("size"))
        heads = keys.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").select("digest", "rep")
        self.copies = materialise(keys.join(heads, "digest").where("id <> rep").select("rep", "id", "size").distinct(), "copies")
        self.texts = texts.join(self.copies.select("id"), "id", "left_anti")
        # Read twice and hashed twice: that costs less than a table of all anchors.
        anchors = self.texts.mapInArrow(_anchor_mapper(half), f"id {self.id_type}, pos long, h long, fresh int")
        # Level 1: an anchor survives if two records have it (or two pieces of one long text; classes tell).
        # Partial aggregation keeps hot anchors small.
        repeated = anchors.groupBy("h").agg(F.sum("fresh").alias("records")).where("records > 1").select("h")
        # As a table its size is known when the join is planned, so where few anchors are alive the texts don't travel.
        alive = materialise(anchors.join(repeated, "h", "left_semi").groupBy("id").agg(F.collect_list(F.struct("pos", "h")).alias("at")), "alive")
        located = self.texts.join(alive, "id").select("id", "text", "at")
        self.members = materialise(located.mapInArrow(_context_mapper(half), f"id {self.id_type}, {_CONTEXT}"), "contexts")
        # Level 2: classes of equal surroundings, and what unlike classes have in common.
        self.classes = materialise(
            self.members.groupBy("h", "k").agg(
                F.min("l").alias("l"), F.min("m").alias("m"), F.min("r").alias("r"), F.min("id").alias("lo"), F.max("id").alias("hi")
            ),
            "classes",
        )
        self._crowded: DataFrame | None = None

    def _sides(self, pairs: DataFrame) -> DataFrame:
        """(h, ka, kb, left, right): what pairs of classes have in common, if it is ``min_len`` or more."""
        linked = pairs.select("h", "ka", "kb", "la", "ma", "ra", "lb", "mb", "rb").mapInArrow(_extend_mapper, "h long, ka binary, kb binary, left int, right int")
        return linked.where(F.col("left") + F.col("right") >= self.half)

    def _named(self, side: str) -> DataFrame:
        return self.classes.select("h", *[F.col(c).alias(c + side) for c in "klmr"])

    def _crowds(self) -> DataFrame:
        """Anchors with more than one class, and how many."""
        if self._crowded is None:
            self._crowded = materialise(self.classes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "crowds")
        return self._crowded

    def _links(self) -> DataFrame:
        """Linked classes of anchors with few classes."""
        few = self._crowds().where(F.col("n") <= PAIRWISE_CLASSES).select("h")
        a, b = (self._named(x).join(few, "h", "left_semi") for x in "ab")
        return self._sides(a.join(b, "h").where("ka < kb"))

    def _shifted(self) -> DataFrame:
        """(h, k, s, w, c): windows of ``min_len`` around anchors with many classes, by shift and content, and the character before."""
        half = self.half
        many = self.classes.join(self._crowds().where(F.col("n") > PAIRWISE_CLASSES).select("h"), "h", "left_semi")
        each = many.select("h", "k", "l", "m", "r", F.explode(F.sequence(F.lit(0), F.lit(half))).alias("s"))
        fits = each.where((F.length("l") >= F.col("s")) & (F.length("r") >= half - F.col("s")))
        window = F.concat(F.expr("substr(l, 1, s)"), F.lit("\0"), F.col("m").cast("string"), F.lit("\0"), F.expr(f"substr(r, 1, {half} - s)"))
        before = F.when((F.col("s") < half) & (F.length("l") > F.col("s")), F.expr("cast(substr(l, s + 1, 1) as binary)")).otherwise(F.col("k"))
        return fits.select("h", "k", "s", F.unhex(F.md5(window.cast("binary"))).alias("w"), before.alias("c"))

    def _crowded_links(self) -> DataFrame:
        """Linked classes of anchors with many classes: they meet at the shift where what they have in common begins."""
        shifted = materialise(self._shifted(), "shifted")
        a, b = (shifted.select("h", "s", "w", F.col("k").alias("k" + x), F.col("c").alias("c" + x)) for x in "ab")
        met = a.join(b, ["h", "s", "w"]).where("ka < kb AND ca <> cb").select("h", "ka", "kb").distinct()
        return self._sides(met.join(self._named("a"), ["h", "ka"]).join(self._named("b"), ["h", "kb"]))

    def links(self) -> DataFrame:
        """``a``, ``b`` (a before b): records with a common stretch, one record for each class of equal texts."""
        # Equal surroundings: records meet where their anchors before differ.
        starts = self.members.groupBy("k").agg(F.min("prev").alias("first"), F.max("prev").alias("last")).where("first <> last").select("k")
        begun = materialise(self.members.join(starts, "k", "left_semi").select("k", "prev", "id").distinct(), "begun")
        subs = begun.select("k", "prev").distinct()
        met = subs.withColumnRenamed("prev", "pa").join(subs.withColumnRenamed("prev", "pb"), "k").where("pa < pb")
        a, b = (begun.select("k", F.col("prev").alias("p" + x), F.col("id").alias("i" + x)) for x in "ab")
        same = met.join(a, ["k", "pa"]).join(b, ["k", "pb"]).select("ia", "ib")
        # Unlike surroundings: and where the anchors after differ, too.
        linked = materialise(self._links().union(self._crowded_links()).select("h", "ka", "kb"), "linked")
        ends = linked.select("h", F.explode(F.array("ka", "kb")).alias("k")).distinct()
        near = materialise(self.members.join(ends, ["h", "k"], "left_semi").select("h", "k", "prev", "next", "id").distinct(), "ends")
        subs = near.select("h", "k", "prev", "next").distinct()
        sub_a, sub_b = (subs.select("h", F.col("k").alias("k" + x), F.col("prev").alias("p" + x), F.col("next").alias("n" + x)) for x in "ab")
        apart = linked.join(sub_a, ["h", "ka"]).join(sub_b, ["h", "kb"]).where("pa <> pb AND na <> nb")
        a, b = (near.select("h", F.col("k").alias("k" + x), F.col("prev").alias("p" + x), F.col("next").alias("n" + x), F.col("id").alias("i" + x)) for x in "ab")
        across = apart.join(a, ["h", "ka", "pa", "na"]).join(b, ["h", "kb", "pb", "nb"]).select("ia", "ib")
        found = same.union(across).where("ia <> ib")
        return found.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()

    def classes_of_texts(self) -> DataFrame:
        """``id``, ``rep``: for each record with copies the one that stands for it in ``links``."""
        return self.copies.select("id", "rep").union(self.copies.select(F.col("rep").alias("id"), "rep").distinct())

    def pairs(self) -> DataFrame:
        """``id_a``, ``id_b`` (a before b): records with a common stretch, each pair once, copies written out."""
        copies = materialise(self.classes_of_texts(), "class-members")
        same = copies.select("rep", F.col("id").alias("a")).join(copies.select("rep", F.col("id").alias("b")), "rep").where("a < b")
        left = self.links().join(copies.select(F.col("rep").alias("a"), F.col("id").alias("ma")), "a", "left")
        both = left.join(copies.select(F.col("rep").alias("b"), F.col("id").alias("mb")), "b", "left")
        spread = both.select(F.coalesce("ma", "a").alias("a"), F.coalesce("mb", "b").alias("b"))
        # Both parts are distinct and have nothing in common: copies aren't linked with each other.
        return same.select("a", "b").union(spread).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))

    def _stretches(self) -> DataFrame:
        """``id``, ``start``, ``stop``: stretches around anchors that other texts have, copies left out."""
        half = self.half
        members = self.members.select("h", "k", "id", "pos", F.length("l").alias("nl"), F.length("r").alias("nr"))
        shared = self.classes.where("lo <> hi").select("h", "k")
        same = members.join(shared, ["h", "k"], "left_semi").select("id", (F.col("pos") - F.col("nl")).alias("start"), (F.col("pos") + half + F.col("nr")).alias("stop"))
        owners = [self.classes.select("h", F.col("k").alias("k" + x), F.col("lo").alias("lo" + x), F.col("hi").alias("hi" + x)) for x in "ab"]
        foreign = self._links().join(owners[0], ["h", "ka"]).join(owners[1], ["h", "kb"]).where("loa <> hia OR lob <> hib OR loa <> lob")
        sides = foreign.select("h", F.explode(F.array("ka", "kb")).alias("k"), "left", "right").distinct()
        across = sides.join(members, ["h", "k"]).select("id", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + half + F.col("right")).alias("stop"))
        shifted = self._shifted().join(self.members.select("h", "k", "id", "pos"), ["h", "k"])
        hot = shifted.groupBy("h", "s", "w").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
        many = shifted.join(hot.select("h", "s", "w"), ["h", "s", "w"], "left_semi").select(
            "id", (F.col("pos") - F.col("s")).alias("start"), (F.col("pos") - F.col("s") + 2 * half).alias("stop")
        )
        return same.unionByName(across).unionByName(many).distinct()

    def _longest(self, stretches: DataFrame) -> DataFrame:
        """``id``, ``longest_span``: the longest stretch a text shares with one other, by doubling."""
        length = 2 * self.half
        starts = stretches.groupBy("id").agg(F.collect_set("start").alias("at"))
        level = materialise(self.texts.join(starts, "id").select("id", "text", "at").mapInArrow(_level_mapper(length), f"id {self.id_type}, start long, levels array<binary>"), "level")
        levels = []
        while True:
            rows = level.where(F.size("levels") > len(levels)).withColumn("w", F.col("levels")[len(levels)])
            often = rows.groupBy("w").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("w")
            level = materialise(rows.join(often, "w", "left_semi").select("id", "start", "levels", "w"), "level")
            if level.isEmpty():
                break
            levels.append(level)
        if not levels:
            return stretches.sparkSession.createDataFrame([], f"id {self.id_type}, longest_span long")
        every = levels[0].select("id", F.lit(0).alias("level"), "start", "w")
        for k, rows in enumerate(levels[1:], 1):
            every = every.union(rows.select("id", F.lit(k).alias("level"), "start", "w"))
        top = materialise(every.groupBy("id").agg(F.max("level").alias("top")), "top")
        # The groups in which a record has its last level, with all that are in them.
        marked = every.join(top, "id").withColumn("needy", F.col("level") == F.col("top"))
        wanted = marked.where("needy").select("level", "w").distinct()
        size = F.lit(length) * F.pow(F.lit(2), F.col("level")).cast("long")
        state = materialise(marked.join(wanted, ["level", "w"], "left_semi").select("id", F.col("w").alias("g"), "start", size.alias("size"), size.alias("room"), "needy"), "narrow")
        room = length << (len(levels) - 1)
        while room > 1:
            state, room = materialise(self._narrowed(state), "narrow"), -(-room // RADIX)
        return state.where("needy").groupBy("id").agg(F.max("size").alias("longest_span"))

    def _narrowed(self, state: DataFrame) -> DataFrame:
        """One step towards the exact lengths: a group is parted by what its rows extend to.

        A row goes where it is furthest from being alone; rows that others are compared with come along.
        """
        at = state.groupBy("id").agg(F.collect_list(F.struct("g", "start", "size", "room", "needy")).alias("at"))
        schema = f"id {self.id_type}, g binary, start long, size long, room long, needy boolean, i int, w binary"
        rows = materialise(self.texts.join(at, "id").select("id", "text", "at").mapInArrow(_narrow_mapper, schema), "extended")
        often = rows.groupBy("g", "i", "w").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi OR i = 0").select("g", "i", "w")
        shared = rows.join(often, ["g", "i", "w"], "left_semi")
        furthest = F.max("i").over(Window.partitionBy("g", "id", "start"))
        placed = shared.withColumn("needy", F.col("needy") & (F.col("i") == furthest))
        wanted = placed.where("needy").select("g", "i", "w").distinct()
        part = F.unhex(F.md5(F.concat("g", "w", F.col("i").cast("string").cast("binary"))))
        return placed.join(wanted, ["g", "i", "w"], "left_semi").select("id", part.alias("g"), "start", "size", "room", "needy")

    def coverage(self) -> DataFrame:
        """``id``, ``n_spans``, ``shared_chars``, ``longest_span``: how much of a record is found elsewhere.

        ``shared_chars`` are the characters within any shared stretch, ``n_spans`` the parts of the text they make up (stretches that overlap are
        one part, whoever shares them; stretches that only touch are two), ``longest_span`` is the longest stretch shared with one other record.
        """
        stretches = materialise(self._stretches(), "stretches")
        w = Window.partitionBy("id").orderBy("start", "stop")
        before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
        fresh = stretches.withColumn("before", F.coalesce(before, F.lit(-1)))
        spans = fresh.withColumn("span", F.sum((F.col("start") >= F.col("before")).cast("int")).over(w))
        merged = spans.groupBy("id", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        parts = merged.groupBy("id").agg(F.count("*").alias("n_spans"), F.sum(F.col("stop") - F.col("start")).alias("shared_chars"))
        whole = self.copies.select(F.explode(F.array("rep", "id")).alias("id"), "size").distinct()
        partly = parts.join(self._longest(stretches), "id").join(whole.select("id"), "id", "left_anti")
        return partly.select("id", "n_spans", "shared_chars", "longest_span").union(
            whole.select("id", F.lit(1).cast("long"), F.col("size").cast("long"), F.col("size").cast("long"))
        )
