"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

E-mail addresses, IP addresses, card numbers and telephone numbers that fit strict grammars are the seeds. The words before seeds are
lexical patterns. Patterns and instances form a graph that Spark scores in rounds: a pattern is trusted if most of the different instances behind it
are known to be of one kind, and an instance is known once trusted patterns vouch for it. Trusted patterns then find
identifiers that only fit a loose grammar (numbers of another form, addresses without a dot or with a spelt-out at sign).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import materialise

#: Kinds in their order, by name.
KINDS = ("email", "ip", "card", "phone")
# The strict grammars are written so that each text position is looked at a bounded number of times and nothing recurses: a run of characters
# is entered at its start or where the match before ended, and ends are found by looking around instead of by repeated groups.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++\.{_LABEL}[A-Za-z0-9.-]*?(?<={_LABEL})(?!{_LABEL})(?!\.{_LABEL})"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Loose forms: an address without a dot or with a spelt-out at sign, and any number of 7 to 20 digits.
LOOSE_EMAIL = rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}(?:@| ?[\[(]at[\])] ?){_LABEL}{{1,63}}(?: ?(?:\.|[\[(]dot[\])]) ?{_LABEL}{{1,63}}){{0,8}}(?!{_LABEL})"
LOOSE_NUMBER = r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().:-]{0,2}[0-9]){6,19}(?![0-9A-Za-z])"
#: Members of a block of running sums.
STEP = 128


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether the digits of a string fulfil the Luhn check."""
    turned = F.reverse(_digits(x))

    def term(i: Column) -> Column:
        digit = F.substring(turned, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).otherwise(F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2))

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda total, i: total + term(i)) % 10 == 0


def _context(piece: Column) -> Column:
    """The last two words of what stands before a match, in lower case."""
    return F.lower(F.regexp_extract(F.right(piece, F.lit(80)), r"(?:\S+\s+)?\S+\s*$", 0))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _running(x: Column, zero: Column, levels: int = 2) -> Column:
    """Sums of what stands before each member of an array.

    Blocks of STEP members are summed, their sums run in the same way, and each block goes on from there. Growing an array copies it, so
    only blocks and the last level's sums, a few members up to millions of them, are grown one by one.
    """

    def grown(values: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.slice(F.array(zero), 1, 0).alias("made"))
        step = lambda state, v: F.struct((state["at"] + v).alias("at"), F.concat(state["made"], F.array(state["at"])).alias("made"))
        return F.aggregate(values, empty, step, lambda state: state["made"])

    if not levels:
        return grown(x, zero)
    numbers = lambda v: F.slice(F.sequence(F.lit(0), F.ceil(F.size(v) / STEP).cast("int")), F.lit(1), F.ceil(F.size(v) / STEP).cast("int"))
    cut = lambda v: F.transform(numbers(v), lambda b: F.slice(v, b * STEP + 1, F.lit(STEP)))
    total = lambda block: F.aggregate(block, zero, lambda sum_, v: sum_ + v)
    joined = lambda blocks: F.flatten(F.zip_with(blocks, _running(F.transform(blocks, total), zero, levels - 1), grown))
    return _let(x, lambda v: _let(cut(v), joined))


def _matches(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<start, end, value, left>> of the matches of a pattern, in code points; the end is exclusive.

    Matches and the pieces between them alternate, so running sums of their lengths give the places.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = _let(found, lambda m: F.zip_with(m, F.slice(pieces, F.lit(1), F.size(m)), lambda v, p: F.struct(v.alias("value"), F.length(p).alias("before"), F.length(v).alias("n"), _context(p).alias("left"))))

    def placed(pair: Column) -> Column:
        ends = _running(F.transform(pair, lambda x: x["before"] + x["n"]), F.lit(0))
        return F.zip_with(pair, ends, lambda x, at: F.struct((at + x["before"]).alias("start"), (at + x["before"] + x["n"]).alias("end"), x["value"].alias("value"), x["left"].alias("left")))

    spans = F.when(gate & F.rlike(text, F.lit(pattern)), _let(pairs, placed))
    return F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,value:string,left:string>>"))


def _seeds(text: Column) -> Column:
    """The spans that fit the strict grammars, with their kinds as numbers, by start and then kind."""
    number = F.rlike(text, F.lit("[0-9]"))
    strict = (
        (EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        (IP, number, lambda v: F.rlike(v, F.lit(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"))),
        (CARD, number, _luhn),
        (PHONE, F.contains(text, F.lit("+")), lambda v: F.length(_digits(v)).between(10, 15)),
    )

    def of(kind: int, pattern: str, gate: Column, good: Callable[[Column], Column]) -> Column:
        fit = F.filter(_matches(text, pattern, gate), lambda x: good(x["value"]))
        return F.transform(fit, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value"), x["left"].alias("left")))

    return F.array_sort(F.concat(*(of(kind, *x) for kind, x in enumerate(strict))))


def _apart(spans: Column, seeds: Column) -> Column:
    """The spans that overlap no seed.

    Ends of seeds, ends of spans, starts of seeds and starts of spans are put in one order, in which running counts give the seeds that start
    before a span's end and those that end before its start: the difference is how many overlap it.
    """
    many = 1 << 32  # starts are counted above this, ends below

    def event(at: Column, order: int, n: int, index: Column | None = None) -> Column:
        return F.struct(at.cast("int").alias("at"), F.lit(order).alias("order"), F.lit(n).cast("bigint").alias("n"), (F.lit(-1) if index is None else index).cast("int").alias("index"))

    def counted(own: Column) -> Column:
        seen = F.concat(F.transform(seeds, lambda s: event(s["end"], 0, 1)), F.transform(seeds, lambda s: event(s["start"], 2, many)), F.transform(own, lambda x, i: event(x["end"], 1, 0, i)), F.transform(own, lambda x, i: event(x["start"], 3, 0, i)))

        def looked_up(events: Column) -> Column:
            sums = F.zip_with(events, _running(F.transform(events, lambda e: e["n"]), F.lit(0).cast("bigint")), lambda e, n: F.struct(e["index"].alias("index"), e["order"].alias("order"), n.alias("n")))
            # of each span first what its end saw, then what its start saw
            return _let(F.array_sort(F.filter(sums, lambda e: e["index"] >= 0)), lambda both: F.filter(own, lambda x, i: F.shiftright(F.get(both, 2 * i)["n"], 32) == F.get(both, 2 * i + 1)["n"].bitwiseAND(F.lit(many - 1).cast("bigint"))))

        return _let(F.array_sort(seen), looked_up)

    return F.when((F.size(spans) == 0) | (F.size(seeds) == 0), spans).otherwise(_let(spans, counted))


def _loose(text: Column, seeds: Column) -> Column:
    """Spans of the loose grammars that overlap no seed; numeric says which grammar."""

    def of(numeric: bool, pattern: str, gate: Column) -> Column:
        return F.transform(_matches(text, pattern, gate), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(numeric).alias("numeric"), x["value"].alias("value"), x["left"].alias("left")))

    spans = of(False, LOOSE_EMAIL, F.rlike(text, F.lit(r"@|[\[(]at[\])]"))), of(True, LOOSE_NUMBER, F.rlike(text, F.lit("[0-9]")))
    return _let(F.concat(*spans), lambda x: _apart(x, seeds))


def _patterns(left: Column) -> Column:
    """The patterns of a context: its last word and its last two words."""
    words = F.split(F.trim(left), r"\s+")
    return F.array_distinct(F.filter(F.array(F.concat(F.lit("1 "), F.element_at(words, -1)), F.concat(F.lit("2 "), F.array_join(words, " "))), lambda x: F.length(x) > 2))


def _trusted(found: DataFrame, least_seeds: int, least_share: float, rounds: int) -> DataFrame:
    """(pattern, numeric, kind, share) of the patterns that are trusted after the last round."""
    seeds = found.select(F.explode("seeds").alias("x")).select(F.col("x.left").alias("left"), F.col("x.value").alias("value"), (F.col("x.kind") > 0).alias("numeric"), F.col("x.kind").alias("kind"))
    loose = found.select(F.explode("loose").alias("x")).select(F.col("x.left").alias("left"), F.col("x.value").alias("value"), F.col("x.numeric").alias("numeric"), F.lit(None).cast("int").alias("kind"))
    edges = seeds.unionByName(loose).select(F.explode(_patterns(F.col("left"))).alias("pattern"), "value", "numeric", "kind")
    edges = materialise(edges.groupBy("pattern", "numeric", "value").agg(F.min("kind").alias("kind")), "pattern-instances")
    known = edges.where(F.col("kind").isNotNull()).groupBy("value", "numeric").agg(F.min("kind").alias("known"))
    trusted = None
    for _ in range(rounds):
        seen = edges.join(known, ["value", "numeric"], "left")
        totals = [F.count_if(F.col("known") == k).alias(f"n{k}") for k in range(len(KINDS))]
        weight = F.when(F.col("known").isNull(), F.lit(0.5)).otherwise(F.lit(1.0))
        counted = seen.groupBy("pattern", "numeric").agg(F.sum(weight).alias("total"), *totals)
        most = F.greatest(*(F.struct(F.col(f"n{k}").alias("n"), F.lit(-k).alias("turned")) for k in range(len(KINDS))))
        scored = counted.select("pattern", "numeric", "total", most.alias("most")).where((F.col("most.n") >= least_seeds) & (F.col("most.n") >= least_share * F.col("total")))
        trusted = materialise(scored.select("pattern", "numeric", (-F.col("most.turned")).alias("kind"), (F.col("most.n") / F.col("total")).alias("share")), "trusted-patterns")
        if trusted.isEmpty():
            break
        doubt = edges.join(known, ["value", "numeric"], "left_anti").join(trusted.withColumnRenamed("kind", "vouched"), ["pattern", "numeric"])
        belief = doubt.groupBy("value", "numeric", F.col("vouched").alias("known")).agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-9)))))).alias("belief"))
        new = materialise(belief.where(F.col("belief") >= least_share).groupBy("value", "numeric").agg(F.max_by("known", F.struct("belief", -F.col("known"))).alias("known")), "new-instances")
        if new.isEmpty():
            break
        known = materialise(known.unionByName(new), "known-instances")
    return trusted


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_seeds: int = 3, least_share: float = 0.6, rounds: int = 3) -> DataFrame:
    """(id_col, seeds, spans) for each row of df: arrays of (start, kind, end) by start and then kind; spans has seeds and what was discovered.

    Places are code points, ends exclusive; kind is a number into KINDS. A pattern is trusted if at least least_seeds different instances behind it,
    and at least the share least_share of all its different instances (unknown ones count half), are known to be of one kind. Null and empty texts have no spans; texts are taken whole;
    repeated rows get the same spans each, and count once in the graph, which holds different values only. An empty table gives no rows. Other columns are left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", F.xxhash64("text").alias("h"))
    seeded = rows.select("id", "h", "text", _seeds(F.col("text")).alias("seeds"))
    found = materialise(seeded.select("id", "h", "seeds", _loose(F.col("text"), F.col("seeds")).alias("loose")), "identifiers")
    trusted = _trusted(found, least_seeds, least_share, rounds)

    loose = found.where(F.size("loose") > 0).select("id", "h", F.explode("loose").alias("x")).select("id", "h", "x.*")
    voted = loose.select("id", "h", "start", "end", "numeric", F.explode(_patterns(F.col("left"))).alias("pattern")).join(trusted, ["pattern", "numeric"])
    chosen = voted.groupBy("id", "h", "start", "end").agg(F.max_by("kind", F.struct("share", -F.col("kind"))).alias("kind"))
    more = materialise(chosen.groupBy(F.col("id").alias("own"), F.col("h").alias("own_h")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("more")), "discovered")
    joined = found.join(more, F.col("id").eqNullSafe(F.col("own")) & (F.col("h") == F.col("own_h")), "left")
    seeds = F.transform("seeds", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    spans = F.array_sort(F.concat(seeds, F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return joined.select(F.col("id").alias(id_col), seeds.alias("seeds"), spans.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    kinds = F.array(*(F.lit(x) for x in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
