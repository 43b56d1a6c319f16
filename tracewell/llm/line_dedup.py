"""Line deduplication by a segment-partition edit join, with built-in functions only.

A line is removed if an equal line, or one within one edit (a character inserted,
deleted or replaced), comes before it: in a document with a smaller id, or earlier in
its own. Lines are judged on the input, not on what is left. The caller says from what
length on a line is judged for equal ones; for near ones, where an edit means much in a
short line, it is ``LEAST_CHARS`` at least.

With a threshold of one edit a line is split into two segments, and one of them stays
as it is. The other is halved again by the same argument, so of four parts all but one
stay: the text before that part from the start, the text after it from the end. Each
distinct line is indexed under its four (length, part, text around the part), and
probes the index of its own length and of lines one shorter. Many lines may meet under
such a key (numbered ones, say), so their pairs are not listed: lines that meet get a
second round of keys that leave out one character of the part. What agrees there is
verified by the bit-parallel edit distance of a band of diagonals.

Equal lines are combined in the map tasks before anything is joined, so a line that
a third of all documents holds is one row of the index, and its places are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.tables import join_hot, let, rendered, stored

EDITS, PARTS = 1, 4
#: Pieces of a part in the second round of keys.
FINE = 16
#: Lines of fewer characters have no near ones, and by default are not judged at all.
LEAST_CHARS = 24
#: The marks that tell which lines may have a near one take a bit per line, within 2 ** these.
LEAST_BITS, MOST_BITS = 20, 27
BLANKS = " \t\r\x0b\x0c"
NO_ID = (1 << 63) - 1


def edit_distance_within(pattern: Column, text: Column, edits: int) -> Column:
    """Whether two strings are at most ``edits`` edits apart.

    Bit b of a word of 2 * edits + 1 bits stands for the pattern character ``edits``
    below to ``edits`` above the text character at hand. Per text character, one round
    of bit operations updates the vertical differences of the band; the distance is
    followed down the lowest diagonal to the last row of the pattern, then along it.
    """
    top = 2 * edits
    mask = (1 << (top + 1)) - 1

    def num(x: int) -> Column:
        return F.lit(x).cast("long")

    def flip(x: Column) -> Column:
        return F.bitwise_not(x).bitwiseAND(num(mask))

    def halve(x: Column) -> Column:
        return F.shiftright(x, 1)

    def run(p: Column, t: Column) -> Column:
        m, n = F.size(p), F.size(t)

        def match(i: Column) -> Column:
            c = F.get(t, i)
            bits = num(0)
            for b in range(top + 1):
                bits = bits + F.when(F.get(p, i + F.lit(b - edits)) == c, num(1 << b)).otherwise(num(0))
            return bits

        def step(acc: Column, i: Column) -> Column:
            def differences(x: Column) -> Column:
                carry = (x.bitwiseAND(acc["vp"]) + acc["vp"]).bitwiseXOR(acc["vp"])
                return carry.bitwiseOR(x).bitwiseOR(acc["vn"]).bitwiseAND(num(mask))

            def update(d0: Column) -> Column:
                hp = acc["vn"].bitwiseOR(flip(d0.bitwiseOR(acc["vp"])))
                hn = d0.bitwiseAND(acc["vp"])
                down = i < m - F.lit(edits)
                lowest = F.when(d0.bitwiseAND(num(1 << top)) == 0, num(1)).otherwise(num(0))
                along = (F.when(hp.bitwiseAND(acc["at"]) != 0, num(1)).otherwise(num(0))
                         - F.when(hn.bitwiseAND(acc["at"]) != 0, num(1)).otherwise(num(0)))
                return F.struct(
                    hn.bitwiseOR(flip(halve(d0).bitwiseOR(hp))).alias("vp"),
                    halve(d0).bitwiseAND(hp).alias("vn"),
                    F.when(down, acc["at"]).otherwise(halve(acc["at"])).alias("at"),
                    (acc["cost"] + F.when(down, lowest).otherwise(along)).alias("cost"))

            return let(let(match(i), differences), update)

        begin = F.struct(num(((1 << (edits + 1)) - 1) << edits).alias("vp"), num(0).alias("vn"),
                         num(1 << (top - 1)).alias("at"), num(edits).alias("cost"))
        far = F.abs(m - n) > edits
        # a pattern within the band of its end from the start has no row to go down to
        short = F.least(m, n) <= edits
        return F.when(far, F.lit(False)).when(short, F.levenshtein(pattern, text) <= edits).otherwise(
            F.aggregate(F.sequence(F.lit(0), n - F.lit(1)), begin, step)["cost"] <= edits)

    both = F.struct(F.split(pattern, "").alias("p"), F.split(text, "").alias("t"))
    return let(both, lambda x: run(x["p"], x["t"]))


def _around(line: Column, chars: Column, length: Column, part: int | Column) -> Column:
    """Fingerprint of a line without one part, the parts being those of ``length``.

    Characters of one byte each are cut from the bytes, without a walk over the text;
    equal bytes have one fingerprint either way.
    """
    before = F.floor(length * part / PARTS).cast("int")
    after = (length - F.floor(length * (part + 1) / PARTS)).cast("int")

    def sides(x: Column) -> Column:
        return F.xxhash64(F.lit(part), length, F.substring(x, F.lit(1), before), F.substring(x, chars - after + F.lit(1), after))

    return F.when(F.octet_length(line) == chars, sides(line.cast("binary"))).otherwise(sides(line))


def _trimmed(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def _word(h: Column, bits: int) -> Column:
    """Word of a fingerprint in the marks."""
    return F.shiftrightunsigned(h, 64 - bits).bitwiseAND(F.lit((1 << bits - 6) - 1)).cast("int")


def _bit(h: Column) -> Column:
    return h.bitwiseAND(F.lit(63)).cast("int")


def _marks(wanted: DataFrame, h: str, bits: int) -> Column:
    """An array of ``2 ** bits`` bits, those of the wanted fingerprints set. It spares
    most rows a shuffle; when many are wanted it only spares fewer."""
    words = wanted.groupBy(_word(F.col(h), bits).alias("_w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col(h)))).alias("_m"))
    every = wanted.sparkSession.range(1 << bits - 6).select(F.col("id").cast("int").alias("_w"))
    filled = every.join(words, "_w", "left").select("_w", F.coalesce("_m", F.lit(0).cast("long")).alias("_m"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("_w", "_m"))), lambda x: x["_m"]).alias("marks")).scalar()


def _is_marked(marks: Column, h: Column, bits: int) -> Column:
    return F.call_function("shiftright", F.get(marks, _word(h, bits)), _bit(h)).bitwiseAND(F.lit(1)) == 1


def _met(distinct: DataFrame, total: int, bits: int = LEAST_BITS) -> DataFrame:
    """(h, met): the places where a line meets others under a key, bit 4 * role + part.

    A line of the same length under its own key is role 0, a longer one role 1; a line
    that probes and finds a shorter one is role 2. Only counts of a key are taken, so a
    key of very many lines costs as many rows, not their pairs.
    """
    own, less = [f"own{i}" for i in range(PARTS)], [f"less{i}" for i in range(PARTS)]
    keys = distinct.select("h", F.posexplode(F.array(*own, *less)).alias("slot", "key"))
    probes = F.col("slot") >= PARTS
    sizes = (keys.groupBy("key").agg(F.count_if(~probes).alias("own"), F.count_if(probes).alias("less"))
             .filter("own > 1 or (own = 1 and less > 0)"))

    def bit(role: int, where: Column) -> Column:
        at = F.pmod("slot", F.lit(PARTS)) + F.lit(PARTS * role)
        return F.when(where, F.call_function("shiftleft", F.lit(1), at)).otherwise(0)

    places = bit(0, ~probes & (F.col("own") > 1)).bitwiseOR(bit(1, ~probes & (F.col("less") > 0))).bitwiseOR(bit(2, probes))
    shared = (distinct.withColumn("_marks", _marks(sizes, "key", bits))
              .select("h", F.posexplode(F.transform(F.array(*own, *less), lambda k: F.when(_is_marked(F.col("_marks"), k, bits), k))).alias("slot", "key"))
              .filter("key IS NOT NULL"))
    return (join_hot(shared, sizes, "key", F.col("own") + F.col("less"), total)
            .groupBy("h").agg(F.bit_or(places).alias("met")).filter("met <> 0"))


def _fine(line: Column, met: Column) -> Column:
    """Per place where a line met others, the keys that leave out one character only.

    The part that may differ is cut into ``FINE`` pieces; the pieces around one stay as they
    are, and of the piece itself each character is left out in turn. Lines of one length
    that agree then differ in that character alone (role 0); a longer line without a
    character agrees with a whole shorter one (role 2 and 1).
    """
    n, none = F.length(line), F.array().cast("array<struct<role:int,key:bigint>>")

    def pieces(at: Column) -> Column:
        role = F.floor(at / PARTS).cast("int")
        more = F.when(role == 2, 1).otherwise(0)
        length = n - more
        part = F.pmod(at, F.lit(PARTS))
        start = F.floor(length * part / PARTS).cast("int")
        size = F.floor(length * (part + 1) / PARTS).cast("int") - start
        whole = F.struct(role.alias("role"), more.alias("more"), size.alias("size"),
                         F.substring(line, start + F.lit(1), size + more).alias("text"),
                         _around(line, n, length, part).alias("around"))
        return let(whole, lambda w: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(FINE - 1)), lambda j: piece(w, j))))

    def piece(w: Column, j: Column) -> Column:
        low = F.floor(w["size"] * j / FINE).cast("int")
        high = F.floor(w["size"] * (j + F.lit(1)) / FINE).cast("int") + w["more"]
        cut = F.struct(F.substring(w["text"], low + F.lit(1), high - low).alias("text"), (high - low).alias("size"),
                       F.xxhash64(w["around"], j, F.substring(w["text"], F.lit(1), low),
                                  F.substring(w["text"], high + F.lit(1), F.length(w["text"]))).alias("around"))
        return let(cut, lambda c: F.when(w["role"] == 1, F.array(key(w, F.xxhash64(c["around"], F.lit(0), c["text"]))))
                   .when(c["size"] == 0, none)
                   .otherwise(F.transform(F.sequence(F.lit(1), c["size"]), lambda k: key(w, without(w, c, k)))))

    def without(w: Column, c: Column, k: Column) -> Column:
        rest = F.concat(F.substring(c["text"], F.lit(1), k - F.lit(1)), F.substring(c["text"], k + F.lit(1), c["size"]))
        return F.xxhash64(c["around"], F.when(w["role"] == 0, k).otherwise(0), rest)

    def key(w: Column, k: Column) -> Column:
        return F.struct(w["role"].alias("role"), k.alias("key"))

    places = F.filter(F.sequence(F.lit(0), F.lit(3 * PARTS - 1)),
                      lambda at: F.call_function("shiftright", met, at).bitwiseAND(F.lit(1)) == 1)
    return F.flatten(F.transform(places, pieces))


def _candidates(found: DataFrame) -> DataFrame:
    """Pairs (x, y), x < y, of distinct lines that agree but for one character.

    Of lines that all differ in one place only, each is paired with the first of them:
    what comes before any of them is known from that one. So the pairs grow with the
    lines, however many share a key.
    """
    fine = found.select("h", "first", "pos", F.explode(_fine(F.col("line"), F.col("met"))).alias("f")).select("h", "first", "pos", "f.*")
    head = F.min(F.struct("first", "pos", "h")).over(Window.partitionBy("key"))
    same = fine.filter("role = 0").withColumn("_m", head).select(F.col("_m.h").alias("a"), F.col("h").alias("b")).filter("a <> b")
    longer = (fine.filter("role = 1").select("key", F.col("h").alias("a"))
              .join(fine.filter("role = 2").select("key", F.col("h").alias("b")), "key").select("a", "b"))
    return same.unionByName(longer).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                        least_chars: int = LEAST_CHARS) -> DataFrame:
    """The input with the lines that came before taken out of ``text``, and
    ``n_lines`` (lines of ``least_chars`` characters or more), ``n_removed`` and
    ``only_short`` (something was removed and no such line is left).

    Blanks around a line do not count. Shorter lines and blank ones stay; 1 judges
    every line that is not blank. Lines under 24 characters go only if an equal one
    came before. A null text
    stays null, with no lines. A null id comes after all others. Rows of one id, or
    without one, do not remove each other's lines, and a line near others of its row goes
    there only if the first of its like stands in that row, too. All columns of the input stay; those of the three
    new names are replaced. An empty table gives no rows. Lines are compared by 64-bit
    fingerprints where they are equal, and in full where they are near.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "only_short")]
    keyed = docs.select(*names, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_doc"))
    line, n = F.col("line"), F.length("line")
    least_chars = max(1, least_chars)
    held = keyed.select("_doc", F.posexplode(_trimmed(rendered(text))).alias("pos", "line")).filter(n >= least_chars)
    long = held.filter(n >= LEAST_CHARS)
    lines = stored(held.select("_doc", F.xxhash64("line").alias("h")), "lines")
    keys = {f"own{i}": _around(line, n, n, i) for i in range(PARTS)} | {f"less{i}": _around(line, n, n - F.lit(1), i) for i in range(PARTS)}
    distinct = long.groupBy(F.xxhash64("line").alias("h")).agg(*[F.max(key).alias(name) for name, key in keys.items()])
    total = lines.count()
    bits = min(MOST_BITS, max(LEAST_BITS, total.bit_length()))
    met = stored(_met(distinct, 2 * PARTS * total, bits), "met")
    place = lines.groupBy("h").agg(F.min("_doc").alias("first"), F.max("_doc").alias("last"), F.count("*").alias("held"))

    # the texts of lines that meet: a marked line may be another one, the join decides
    marked = long.withColumn("h", F.xxhash64("line")).withColumn("_marks", _marks(met, "h", bits)).filter(
        _is_marked(F.col("_marks"), F.col("h"), bits))
    found = stored(marked.groupBy("h").agg(F.min(F.struct("_doc", "pos", "line")).alias("_f")).join(met, "h")
                   .select("h", "met", F.col("_f._doc").alias("first"), "_f.pos", "_f.line"), "found")
    pairs = stored(_candidates(found), "pairs")
    sides = [found.select(F.col("h").alias(s), F.col("line").alias(f"line_{s}"), F.col("first").alias(f"first_{s}")) for s in "xy"]
    texts = pairs.join(sides[0], "x").join(sides[1], "y")
    # of two lines one edit apart, the first halves or the second halves are equal
    half = F.floor(F.least(F.length("line_x"), F.length("line_y")) / 2).cast("int")
    plausible = (F.left("line_x", half) == F.left("line_y", half)) | (F.right("line_x", half) == F.right("line_y", half))
    near = stored(texts.filter(plausible & edit_distance_within(F.col("line_x"), F.col("line_y"), EDITS))
                  .select("x", "y", "first_x", "first_y"), "near")

    both = F.array(F.struct(F.col("x").alias("h"), F.col("first_y").alias("near")), F.struct(F.col("y").alias("h"), F.col("first_x").alias("near")))
    nearest = near.select(F.explode(both).alias("p")).select("p.*").groupBy("h").agg(F.min("near").alias("near"))
    earliest = (place.join(nearest, "h", "left").select("h", "last", "held", F.least("first", F.coalesce("near", "first")).alias("earliest"))
                .filter("earliest < last").drop("last"))
    # a line of very many rows does not gather them in one task
    gone = (join_hot(lines.select("_doc", "h"), earliest, "h", F.col("held"), total).filter("earliest < _doc")
            .groupBy("_doc").agg(F.collect_set("h").alias("_g")))
    inside = (near.filter("first_x = first_y").groupBy(F.col("first_x").alias("_doc"))
              .agg(F.collect_set(F.struct("x", "y")).alias("_i")))
    marks = gone.join(inside, "_doc", "full")
    none, no_pairs = F.array().cast("array<bigint>"), F.array().cast("array<struct<x:bigint,y:bigint>>")
    joined = keyed.join(marks, "_doc", "left").select(
        *names, F.split(rendered(text), "\n").alias("_raw"),
        F.transform(_trimmed(rendered(text)), lambda x: F.when(F.length(x) >= least_chars, F.xxhash64(x))).alias("_hashes"),
        F.coalesce("_g", none).alias("_gone"), F.coalesce("_i", no_pairs).alias("_inside"))
    at = [lambda p, s=s: F.array_position("_hashes", p[s]) for s in "xy"]
    both_here = F.filter("_inside", lambda p: (at[0](p) > 0) & (at[1](p) > 0))
    later = F.transform(both_here, lambda p: F.when(at[0](p) < at[1](p), p["y"]).otherwise(p["x"]))
    # per line whether its like stands before it: sorted by fingerprint and place, what is
    # gone at place -1, a line is repeated if the entry before has its fingerprint
    entries = F.array_sort(F.concat(
        F.filter(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: x["h"].isNotNull()),
        F.transform(F.concat("_gone", later), lambda h: F.struct(h.alias("h"), F.lit(-1).alias("i")))))
    repeated = let(entries, lambda e: F.array_sort(F.transform(
        F.filter(e, lambda x, k: (x["i"] >= 0) & F.coalesce(F.get(e, k - F.lit(1))["h"] == x["h"], F.lit(False))),
        lambda x: x["i"])))
    flagged = joined.withColumn("_out", repeated)

    # the lines between one removed line and the next, in one pass over the removed
    def between(out: Column) -> Column:
        edges = F.concat(F.array(F.lit(-1)), out, F.array(F.size("_raw")))
        return let(edges, lambda e: F.flatten(F.transform(
            F.sequence(F.lit(0), F.size(e) - F.lit(2)),
            lambda k: F.slice("_raw", F.get(e, k) + F.lit(2), F.get(e, k + F.lit(1)) - F.get(e, k) - F.lit(1)))))

    kept = F.when(F.size("_out") == 0, F.col(text)).otherwise(F.array_join(between(F.col("_out")), "\n"))
    n_lines = F.size(F.filter("_hashes", lambda h: h.isNotNull())).cast("long")
    return flagged.select(
        *[kept.alias(c) if c == text else F.col(c) for c in names],
        n_lines.alias("n_lines"), F.size("_out").cast("long").alias("n_removed"),
        ((F.size("_out") > 0) & (n_lines == F.size("_out"))).alias("only_short"))
