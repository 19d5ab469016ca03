"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines of any length that agree but for blanks at their ends, and lines of at least ``min_chars`` characters that are within
``tau`` edits of one another (directly or through others), form a class; the class's first line (by document id and place)
stays, the others go. Equal lines meet by a 128-bit hash. For the rest every line of that length is cut into tau + 1 segments of even length: two lines
within tau edits share one of them, at a place that their lengths and the segment's number bound, so a line probes the
segment indexes of its own and the tau shorter lengths with those substrings alone. Pairs that meet are verified by the
banded bit-parallel edit distance, of whose matrix only 2 tau + 1 diagonals are kept, in the bits of a long.

Lines that share a segment become a pair only if their lengths and the counts of their letters allow tau edits. Segments that
many lines share are dealt to several tasks (``HOT`` lines each) before they are paired.

Edge cases: null text has no lines and stays null; lines of white space alone always stay; rows that repeat both id
and text count as one document; null ids come first; lines of up to 2 tau characters
meet only their equals; very long lines are compared whole; an empty table gives no rows; extra columns go through as they
are, but for n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, partitions_for

TAU = 2
MIN_CHARS = 9  # of lines in the edit join: no line of five words is shorter; equal lines meet at any length
LETTERS = "etaoinshrdlucmpf"  # counted, four bits each, for the bag filter
BROADCAST = 2_000_000  # line hashes sent to executors at once; more are joined by a shuffle
HOT = 1000  # lines of one segment that one task pairs with the others of the segment
WHITE = " \t\r\f\x0b"


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, version, pos, line, h1, h2) of the lines that are not white space alone."""
    bare = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)))  # once a line, ahead of the filter
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(bare).alias("pos", "line")).where("line <> ''")
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), "line")})


def _probes(tau: int) -> Column:
    """What a line looks up: (index, d, i, o), its own segments i (index true; it is looked up by others, too) and the
    substrings at offset o from where segment i starts in lines d shorter. The offsets are bounded by the segment's number
    from either end."""
    out = []
    for d in range(tau + 1):
        for i in range(1, tau + 2):
            out += [(d == 0 and o == 0, d, i, o) for o in range(max(-(i - 1), d - (tau + 1 - i)), min(i - 1, d + (tau + 1 - i)) + 1)]
    return F.array(*[F.struct(F.lit(x).alias("index"), F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(o).alias("o")) for x, d, i, o in out])


def _keys(lines: DataFrame, tau: int) -> DataFrame:
    """(key, h1, ni): one row for each segment and probe of each line; ni is twice its length, and one more for its own segments.
    Lines are longer than 2 tau, so every segment has a character and every probe lies inside the line."""
    k = tau + 1
    rows = lines.select("h1", F.length("line").alias("n"), "line", F.explode(_probes(tau)).alias("p"))
    rows = rows.select("h1", "n", "line", "p.index", "p.i", "p.o", (F.col("n") - F.col("p.d")).alias("m"))
    base = F.call_function("div", F.col("m"), F.lit(k)).cast("int")
    longer = F.greatest(F.lit(0), F.col("i") - 1 - (k - F.col("m") % k))  # the last segments take the remainder
    start = base * (F.col("i") - 1) + longer + 1 + F.col("o")
    size = base + F.when(F.col("i") > k - F.col("m") % k, 1).otherwise(0)
    return rows.select(F.xxhash64("m", "i", F.substring("line", start.cast("int"), size.cast("int"))).alias("key"), "h1", (F.col("n") * 2 + F.col("index").cast("int")).alias("ni"))


def _chunks_agree(tau: int, chunks: int = 12) -> Column:
    """Whether all chunks of x but tau stand in y within tau of their place: an edit breaks one chunk, and shifts by one."""
    n = F.length("x")
    base = F.call_function("div", n, F.lit(chunks)).cast("int")
    found = F.lit(0)
    for c in range(chunks):
        start, size = base * c + 1, base if c < chunks - 1 else n - base * (chunks - 1)
        low = F.greatest(F.lit(1), start - tau)
        found = found + F.contains(F.substring("y", low, start + size + tau - low), F.substring("x", start, size)).cast("int")
    return (base == 0) | (found >= chunks - tau)


def _sign() -> Column:
    """How often each of the letters stands in the line, modulo 16, four bits each."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        count = (F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))).cast("long")
        out = out.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(15).cast("long")), 4 * k))
    return out


def _near(a: Column, b: Column, tau: int) -> Column:
    """Whether two signatures allow tau edits: each edit changes at most two counts by one."""
    nibble = lambda x, k: F.shiftrightunsigned(x, 4 * k).bitwiseAND(F.lit(15).cast("long"))
    total = F.lit(0).cast("long")
    for k in range(len(LETTERS)):
        d = (nibble(a, k) - nibble(b, k)).bitwiseAND(F.lit(15).cast("long"))
        total = total + F.least(d, F.lit(16).cast("long") - d)
    return total <= 2 * tau


def banded_distance(longer: Column, shorter: Column, tau: int) -> Column:
    """Edit distance of two arrays of characters, both longer than tau, whose lengths differ by at most tau; exact up to tau
    (above it: some number above tau).

    Bit-parallel over the 2 tau + 1 diagonals: bit k of a step's words stands for row i - tau + k of the longer string."""
    a, b = longer, shorter
    m, n = F.size(a), F.size(b)
    w = 2 * tau + 1
    full = F.lit((1 << w) - 1).cast("long")
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")

    def step(s: Column, i: Column) -> Column:
        eq = zero
        for k in range(w):
            row = i - tau + k  # from 0
            hit = (row >= 0) & (row < m) & (F.get(a, row) == F.get(b, i))
            eq = eq.bitwiseOR(F.when(hit, F.lit(1 << k).cast("long")).otherwise(zero))
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["dist"].alias("dist"), eq.alias("eq"), i.alias("i"))

    def move(s: Column) -> Column:
        vp, vn, eq = s["vp"], s["vn"], s["eq"]
        d0 = ((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(full)
        return F.struct(vp.alias("vp"), vn.alias("vn"), s["dist"].alias("dist"), d0.alias("d0"), s["i"].alias("i"))

    def close(s: Column) -> Column:
        vp, vn, d0, i = s["vp"], s["vn"], s["d0"], s["i"]
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(full)
        hn = d0.bitwiseAND(vp)
        down = F.shiftrightunsigned(d0, 1)
        # while the band's last diagonal is inside the longer string its cost is followed; then along the last row
        inside = i < m - tau
        at = (m - 1 - i + tau).cast("int")
        diagonal = F.when(F.shiftrightunsigned(d0, 2 * tau).bitwiseAND(one) == 0, 1).otherwise(0)
        row = F.call_function("shiftrightunsigned", hp, at).bitwiseAND(one) - F.call_function("shiftrightunsigned", hn, at).bitwiseAND(one)
        dist = s["dist"] + F.when(inside, diagonal).otherwise(row).cast("int")
        return F.struct(
            hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(full).alias("vp"), down.bitwiseAND(hp).alias("vn"), dist.alias("dist")
        )

    bind = lambda s, f: F.transform(F.array(s), f)[0]  # noqa: E731  evaluates s once
    # before the first step, row tau holds distance tau; rows above the string count as matches of nothing
    start = F.struct(F.lit(((1 << (tau + 1)) - 1) << tau).cast("long").alias("vp"), zero.alias("vn"), F.lit(tau).alias("dist"))
    end = F.aggregate(F.sequence(F.lit(0), n - 1), start, lambda s, i: bind(bind(step(s, i), move), close))
    return F.when(n == 0, m).otherwise(end["dist"])


def near_pairs(lines: DataFrame, scratch: Scratch, tau: int) -> DataFrame:
    """(a, b) hash pairs of distinct lines within tau edits, of ``lines(line, h1, h2)``."""
    lines = lines.where(F.length("line") > 2 * tau)
    rows = _keys(lines, tau).repartition("key")  # shuffled once: the keys that lines share are found and joined where they lie
    shared = rows.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max(F.col("ni") % 2).alias("index")).where("lo <> hi and index = 1")
    met = scratch.save(rows.join(shared.select("key").hint("shuffle_hash"), "key").distinct())  # a semi-join would go below the shuffle
    ids = scratch.save(met.select("h1").distinct())
    few = F.broadcast(ids) if ids.count() <= BROADCAST else ids
    found = lines.select("h1", "h2", "line").join(few, "h1", "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line"))
    texts = scratch.save(found.withColumn("sign", _sign()))
    busy = met.groupBy("key").agg(F.ceil(F.count("*") / HOT).alias("deals"))
    rows = met.join(texts.select("h1", "h2", "sign"), "h1").join(busy, "key").withColumns({"n": F.expr("ni div 2"), "index": F.expr("ni % 2 = 1")}).drop("ni")
    left = rows.where("index").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).alias("l")
    right = rows.withColumn("deal", F.pmod(F.xxhash64("h1", "h2"), F.col("deals"))).alias("r")
    differ = (F.col("l.h1") != F.col("r.h1")) | (F.col("l.h2") != F.col("r.h2"))
    once = (F.col("l.n") < F.col("r.n")) | (F.struct("l.h1", "l.h2") < F.struct("r.h1", "r.h2"))
    same = (F.col("l.key") == F.col("r.key")) & (F.col("l.deal") == F.col("r.deal"))
    pairs = left.join(right, same & (F.col("l.n") <= F.col("r.n")) & (F.col("r.n") - F.col("l.n") <= tau) & differ & once & _near(F.col("l.sign"), F.col("r.sign"), tau))
    pairs = scratch.save(pairs.select(F.struct("l.h1", "l.h2").alias("a"), F.struct("r.h1", "r.h2").alias("b")).distinct())
    scratch.drop(met, ids)
    texts = texts.select(F.struct("h1", "h2").alias("id"), "line")
    known = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    known = scratch.save(known.where(_chunks_agree(tau)).select("a", "b", F.split("x", "").alias("x"), F.split("y", "").alias("y")))
    known = known.repartition(max(48, partitions_for(lines.sparkSession)))  # few rows, much work
    return known.where(banded_distance(F.col("y"), F.col("x"), tau) <= tau).select("a", "b")


def dedup_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the text without its removed lines, and n_lines and n_removed (both 0 for null text)."""
    scratch = Scratch(docs.sparkSession)
    lines = lines_of(docs)
    places = scratch.save(lines.select("doc_id", "version", "pos", "h1", "h2"))
    near = near_pairs(lines.where(F.length("line") >= min_chars), scratch, tau)
    classes = components(near, scratch)
    first = F.min(F.struct("doc_id", "version", "pos"))
    heads = places.groupBy(F.struct("h1", "h2").alias("id")).agg(first.alias("first"), F.count("*").alias("k"))
    heads = heads.join(classes, "id", "left").withColumn("class", F.coalesce("component_id", "id"))
    best = heads.groupBy("class").agg(F.min("first").alias("best"), F.sum("k").alias("total")).where("total > 1")
    repeated = heads.join(best, "class").select("id.h1", "id.h2", "best")
    gone = places.join(repeated, ["h1", "h2"]).where("struct(doc_id, version, pos) <> best").groupBy("doc_id", "version").agg(F.collect_set("pos").alias("pos"))
    # names that no column of the input has
    mine = "_" * (1 + max(len(c) for c in docs.columns))
    doc, version, pos = (mine + x for x in ("doc", "version", "pos"))
    gone = scratch.save(gone.select(F.col("doc_id").alias(doc), F.col("version").alias(version), F.col("pos").alias(pos)))
    # gone grows with the documents: small or large, both sides are shuffled, and one size tells of another
    out = docs.drop("n_lines", "n_removed").join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(version)), "left")
    parts, none = F.split("text", "\n"), F.col(pos).isNull()
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(pos, i)), "\n")
    n_lines, n_removed = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)), F.when(none, 0).otherwise(F.size(pos))
    out = out.select(*out.columns, n_lines.cast("long").alias(mine + "n"), n_removed.cast("long").alias(mine + "m")).withColumn("text", F.when(none, F.col("text")).otherwise(kept))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*columns, F.col(mine + "n").alias("n_lines"), F.col(mine + "m").alias("n_removed"))
