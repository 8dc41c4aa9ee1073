"""Rule-driven alarm propagation as a fixed loop of joins, one per hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumentrace.functions import scalars as S

from . import topology as T
from .cells import deal, timed_walk, union_walk
from .preparation import ranked


def root_event(ftype: Column) -> Column:
    """The failure assumed for a board of a function type, where none is given."""
    return F.when(ftype == "ODUk-Creation", "Line_Disconnect").when(ftype == "ODUk-Termination", "ODUk_PM_AIS").otherwise("Fiber_Cut")


def asked_for(rules: DataFrame) -> set[tuple[str, str, str]]:
    """The (function type, direction, type looked for) of all transmissions: as many at most as there are pairs of types, both ways."""
    sent = _sent(rules).filter(F.col("to_type").isin(*T.FTYPES))
    return {tuple(r) for r in sent.select("from_type", "direction", "to_type").distinct().collect()}


def _sent(rules: DataFrame) -> DataFrame:
    action = F.lower("action")
    return rules.filter(action.contains("transmit") & ~action.contains("regenout")).withColumn("direction", F.when(action.contains("upstream"), "U").otherwise("D"))


def reactions(rules: DataFrame, typed: DataFrame, targets: DataFrame, adjacency: DataFrame) -> DataFrame:
    """What a board with an alarm causes: board, alarm -> to_board, to_alarm, with rule, direction and edge type.

    Three kinds of action: report locally; transmit to the nearest boards of a type up or down; start anew on the
    regenerator's other side. All boards and alarms at once, so a propagation is a plain self-join afterwards.

    Boards have one type, rules a number each and targets are distinct, so transmissions are distinct by what they are made of, and are
    not exchanged again; boards with their rules are broadcast up to a checked number.
    """
    action = F.lower("action")
    boards = typed.select("board", "ftype").distinct()
    has = lambda of: boards.join(F.broadcast(of.distinct()), F.col("ftype") == F.col("from_type"))
    cols = ["board", "from_alarm", "to_board", "to_alarm", "rule_idx", "direction", "edge_type"]
    local = has(rules.filter(action.contains("report locally"))).withColumns({"to_board": F.col("board"), "direction": F.lit(""), "edge_type": F.lit("")})
    regen = has(rules.filter(action.contains("regenout"))).join(adjacency.filter((F.col("edge_type") == "regen_boundary") & (F.col("direction") == "D")), "board").withColumnRenamed("neighbour", "to_board")
    sent = has(_sent(rules)).select("board", "direction", "to_type", "from_alarm", "to_alarm", "rule_idx").distinct()
    far = targets.join(F.broadcast(sent) if typed.count() <= MAX_ROOTS else sent, ["board", "direction", "to_type"]).withColumnRenamed("target", "to_board")
    return local.select(*cols).unionByName(regen.select(*cols)).distinct().unionByName(far.select(*cols))


#: Roots that travel together, a bit each.
ROOTS = 60
#: Roots whose table is broadcast to the masks; reactions up to which they are broadcast (a number each, packed by where they start), and of them in one task.
MAX_ROOTS, MAX_EDGES, EDGES_A_TASK = 500_000, 8_000_000, 100_000


#: The bits of a mask that are set, a row each.
_BITS = f"filter(sequence(0, {ROOTS - 1}), i -> (shiftright(mask, i) & 1) = 1)"


def propagate(seeds: DataFrame, react: DataFrame, max_hops: int, materialise) -> DataFrame:
    """Untimed walk from ``seeds`` (root, board, alarm): distinct (root, board, alarm, hop). Masks become rows at the end, where no shuffle follows."""
    walked, roots = walk(seeds, react, max_hops, materialise)
    return _rows(walked, roots).select("root", "board", "alarm", "hop")


def _blocks(seeds: DataFrame, materialise) -> DataFrame:
    """The roots of ``seeds`` in blocks of ``ROOTS``: root, block, bit."""
    k = F.col("k") - 1
    return materialise(ranked(seeds.select("root").distinct(), F.col("root")).select("root", F.floor(k / ROOTS).alias("block"), (k % ROOTS).cast("int").alias("bit")), "roots")


def _rows(masks: DataFrame, roots: DataFrame) -> DataFrame:
    """A row for each bit of a mask, with its root; roots are broadcast if their number allows it, so that these rows are not exchanged."""
    known = F.broadcast(roots) if roots.count() <= MAX_ROOTS else roots
    return masks.withColumn("bit", F.explode(F.expr(_BITS))).join(known, ["block", "bit"])


def walk(seeds: DataFrame, react: DataFrame, max_hops: int, materialise) -> tuple[DataFrame, DataFrame]:
    """The same walk as masks (block, board, alarm, hop, mask), and the roots behind their bits (root, block, bit).

    What a row causes depends on its board and alarm only, so the roots of a block of ``ROOTS`` travel as one bit mask per
    board and alarm: a hop joins states with reactions and takes the union of masks, whose partial form is combined
    before the shuffle.
    """
    roots = _blocks(seeds, materialise)
    causes = react.select("board", "from_alarm", "to_board", "to_alarm").distinct()
    own = F.expr("shiftleft(CAST(1 AS BIGINT), bit)")
    level = seeds.join(roots, "root").groupBy("block", "board", "alarm").agg(F.bit_or(own).alias("mask")).withColumn("hop", F.lit(0))
    level = walked = materialise(level, "flow")
    for h in range(1, max_hops + 1):
        nxt = level.select("block", "board", F.col("alarm").alias("from_alarm"), "mask").join(causes, ["board", "from_alarm"])
        nxt = nxt.groupBy("block", F.col("to_board").alias("board"), F.col("to_alarm").alias("alarm")).agg(F.bit_or("mask").alias("mask"))
        level = materialise(nxt.withColumn("hop", F.lit(h)), "flow")
        walked = walked.unionByName(level)
    return walked, roots


def _deal(seeds: DataFrame, roots: DataFrame, react: DataFrame, kind: list[str], apart, materialise):
    at = seeds.join(roots, "root").select("board", "alarm", F.col("block").alias("n"), F.col("bit").cast("long").alias("at"), F.lit(0.0).alias("lasts"))
    return deal(react, at, kind, apart, materialise)


def walk_in_cells(seeds: DataFrame, react: DataFrame, max_hops: int, materialise) -> tuple[DataFrame, DataFrame]:
    """As ``walk``, but all hops of a connected part run in the task that holds its reactions; level by level where a part is too large for that."""
    roots = _blocks(seeds, materialise)
    dealt = _deal(seeds, roots, react, ["from_alarm", "to_alarm"], None, materialise)
    if dealt is None:
        return walk(seeds, react, max_hops, materialise)
    return materialise(dealt.run(union_walk(max_hops), "block long, board long, alarm string, hop int, mask long"), "flow"), roots


def propagate_in_cells(seeds: DataFrame, react: DataFrame, max_hops: int, materialise) -> DataFrame:
    """As ``propagate``, from ``walk_in_cells``."""
    return _rows(*walk_in_cells(seeds, react, max_hops, materialise)).select("root", "board", "alarm", "hop")


def khop_in_cells(links: DataFrame, roots: DataFrame, hops_max: int, materialise) -> DataFrame:
    """As ``topology.khop_region`` of distinct links (src, dst), but all steps within a connected part run in the task that holds its links."""
    way = lambda a, b: links.select(F.col(a).alias("board"), F.lit("").alias("from_alarm"), F.col(b).alias("to_board"), F.lit("").alias("to_alarm"))
    seeds = roots.select(F.col("board").alias("root"), "board", F.lit("").alias("alarm"))
    placed = _blocks(seeds, materialise)
    dealt = _deal(seeds, placed, way("src", "dst").unionByName(way("dst", "src")), ["from_alarm", "to_alarm"], None, materialise)
    if dealt is None:
        return T.khop_region(links, roots, hops_max, materialise)
    masks = dealt.run(union_walk(hops_max, once=True), "block long, board long, alarm string, hop int, mask long")
    return _rows(masks, placed).select("root", "board", "hop")


def _by_root(masks: DataFrame, *by: str) -> DataFrame:
    """Masks dealt by their block and grouped by root (and ``by``): as all bits of a block lie in one place, rows of single roots are never exchanged."""
    return masks.select("*", F.explode(F.expr(_BITS)).alias("bit")).groupBy("block", "bit", *by)


def summary_of_walk(walked: DataFrame, roots: DataFrame) -> DataFrame:
    """What ``flow_summary`` gives, from the masks of a walk."""
    masks = walked.repartition("block")
    kinds = _by_root(masks.select("block", "alarm", "hop", "mask"), "alarm").agg(F.count(F.lit(1)).alias("n"), F.max("hop").alias("hop"))
    boards = _by_root(masks.groupBy("block", "board").agg(F.bit_or("mask").alias("mask"))).agg(F.count(F.lit(1)).alias("boards"))
    return _sums(kinds, "block", "bit").join(boards, ["block", "bit"]).join(roots, ["block", "bit"]).select("root", "rows", "alarms", "max_hop", "otuk", "critical", "major", "boards")


def compliance_of_walk(walked: DataFrame, roots: DataFrame, typed: DataFrame) -> DataFrame:
    """What ``regen_compliance`` gives, from the masks of a walk."""
    f = walked.join(typed.select("board", "ftype"), "board").select("block", "mask", *[c.alias(n) for n, c in _compliance().items()]).repartition("block")
    g = _by_root(f).agg(*[F.count_if(n).alias(n) for n in _compliance()])
    return _compliant(g.join(roots, ["block", "bit"]).select("root", *_compliance()))


def timed(flow_seeds: DataFrame, react: DataFrame, max_hops: int, delay_s: int, materialise) -> DataFrame:
    """Walk with times: earliest arrival per (root, board, alarm, hop), provenance of the first cause.

    Local reports come at once, transmissions after ``delay_s`` a hop, the regenerator's other side after one second.

    Roots travel as bits of masks, as in ``walk``. A level's rows that lead to one place are looked at in order of arrival, cause and rule, and
    each keeps the roots that none before it had. Where the reactions are few enough to be broadcast, a block's rows are dealt once before they
    are joined, by block and slice of the places they lead to, so that what the join gives is sorted where it arises and never exchanged.
    """
    roots = _blocks(flow_seeds, materialise)
    n_blocks = roots.agg(F.max("block")).first()[0] or 0
    states = flow_seeds.select("board", "alarm").unionByName(react.select("board", F.col("from_alarm").alias("alarm"))).unionByName(react.select(F.col("to_board").alias("board"), F.col("to_alarm").alias("alarm")))
    states = materialise(ranked(states.distinct(), F.col("board"), F.col("alarm")).select(F.col("k").alias("state"), "board", "alarm"), "flow-states")
    wait = F.when(F.col("direction") == "", 0).when(F.col("edge_type") == "regen_boundary", 1).otherwise(delay_s)
    here, there = states.select(F.col("state").alias("from_state"), "board", F.col("alarm").alias("from_alarm")), states.select(F.col("state").alias("to_state"), F.col("board").alias("to_board"), F.col("alarm").alias("to_alarm"))
    edges = react.withColumn("wait", wait).join(here, ["board", "from_alarm"]).join(there, ["to_board", "to_alarm"])
    edges = materialise(edges.select("from_state", "to_state", F.col("board").alias("prev"), "rule_idx", "wait").distinct(), "flow-edges")
    n_edges = edges.count()
    slices = 1 + n_edges // EDGES_A_TASK
    packed = edges.groupBy((F.col("to_state") % slices).alias("slice"), "from_state", "prev", "rule_idx", "wait").agg(F.collect_list("to_state").alias("to"))

    own = F.expr("shiftleft(CAST(1 AS BIGINT), bit)")
    level = flow = flow_seeds.join(states, ["board", "alarm"]).join(roots, "root").select("block", "state", F.lit(0).alias("hop"), F.lit(0).alias("arrival_s"), F.col("board").alias("prev"), F.lit(-1).alias("rule_idx"), own.alias("mask"))
    cols = level.columns
    before = F.bit_or("mask").over(W.partitionBy("block", "slice", "state").orderBy("arrival_s", "prev", "rule_idx").rowsBetween(W.unboundedPreceding, -1))
    for h in range(1, max_hops + 1):
        now = level.groupBy("block", F.col("state").alias("from_state"), "arrival_s").agg(F.bit_or("mask").alias("mask"))
        if n_edges <= MAX_EDGES:
            now = now.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
            step = now.repartition(min(2 * (n_blocks + 1) * slices, 2000), "block", "slice").join(F.broadcast(packed), ["slice", "from_state"]).withColumn("to_state", F.explode("to"))
        else:
            step = now.join(edges, "from_state").withColumn("slice", F.lit(0))
        step = step.select("block", "slice", F.col("to_state").alias("state"), (F.col("arrival_s") + F.col("wait")).alias("arrival_s"), "prev", "rule_idx", "mask")
        new = step.withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce(before, F.lit(0).cast("long"))))).filter("mask <> 0")
        level = materialise(new.withColumn("hop", F.lit(h)).select(*cols), "flow")
        flow = flow.unionByName(level)
    named = flow.join(F.broadcast(states) if states.count() <= MAX_ROOTS else states, "state")
    return _rows(named, roots).select("root", "board", "alarm", "hop", "arrival_s", "prev", "rule_idx")


def timed_in_cells(flow_seeds: DataFrame, react: DataFrame, max_hops: int, delay_s: int, materialise) -> DataFrame:
    """As ``timed``, but all hops of a connected part run in the task that holds its reactions; level by level where a part is too large for that."""
    roots = _blocks(flow_seeds, materialise)
    dealt = _deal(flow_seeds, roots, react, ["from_alarm", "to_alarm", "rule_idx", "direction", "edge_type"], lambda starts: starts.withColumn("apart", F.col("b")), materialise)
    if dealt is None:
        return timed(flow_seeds, react, max_hops, delay_s, materialise)
    waits = lambda k: 0 if k[3] == "" else 1 if k[4] == "regen_boundary" else delay_s
    masks = dealt.run(timed_walk(max_hops, waits), "block long, board long, alarm string, hop int, arrival_s int, prev long, rule_idx int, mask long")
    return _rows(masks, roots).select("root", "board", "alarm", "hop", "arrival_s", "prev", "rule_idx")


def flow_summary(flow: DataFrame) -> DataFrame:
    """Per root: rows, boards, alarms, last hop, rows by family and severity; counts per alarm first, so that few rows are exchanged."""
    kinds = flow.groupBy("root", "alarm").agg(F.count(F.lit(1)).alias("n"), F.max("hop").alias("hop"))
    boards = flow.select("root", "board").distinct().groupBy("root").agg(F.count(F.lit(1)).alias("boards"))
    return _sums(kinds, "root").join(boards, "root")


def _sums(kinds: DataFrame, *by: str) -> DataFrame:
    over = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    severity = S.severity_of_alarm(F.col("alarm"))
    return kinds.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("alarms"), F.max("hop").alias("max_hop"), over(S.alarm_family(F.col("alarm")) == "OTUk").alias("otuk"), over(severity == "Critical").alias("critical"), over(severity == "Major").alias("major")
    )


def lookup_rule(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """(ftype, event) -> rules by exact match (empty type: any); failing that, rules whose event holds the text, flagged fuzzy."""
    same_type = (F.col("q_type") == "") | (F.col("q_type") == F.col("from_type"))
    exact = asked.join(rules, (F.col("q_event") == F.col("from_alarm")) & same_type).withColumn("fuzzy", F.lit(False))
    rest = asked.join(exact.select("q_type", "q_event").distinct(), ["q_type", "q_event"], "left_anti")
    like = rest.join(rules, F.lower("from_alarm").contains(F.lower("q_event")) & same_type).withColumn("fuzzy", F.lit(True))
    return exact.select("q_type", "q_event", "rule_idx", "fuzzy").unionByName(like.select("q_type", "q_event", "rule_idx", "fuzzy"))


def regen_compliance(flow: DataFrame, typed: DataFrame) -> DataFrame:
    """Per root: OTUk alarms beyond hop 0 on termination boards, and regenerator alarms without a termination alarm."""
    f = flow.join(typed.select("board", "ftype"), "board")
    return _compliant(f.groupBy("root").agg(*[F.count_if(c).alias(n) for n, c in _compliance().items()]))


def _compliance() -> dict[str, Column]:
    """What is counted, of rows with ftype."""
    return {
        "otuk_on_termination": (F.col("hop") > 0) & (F.col("ftype") == "ODUk-Termination") & (S.alarm_family(F.col("alarm")) == "OTUk"),
        "regen_ais": (F.col("ftype") == "OTUk-RegenOut") & F.col("alarm").contains("AIS"),
        "termination_oduk": (F.col("ftype") == "ODUk-Termination") & (S.alarm_family(F.col("alarm")) == "ODUk"),
    }


def _compliant(counts: DataFrame) -> DataFrame:
    return counts.withColumn("compliant", (F.col("otuk_on_termination") == 0) & ((F.col("regen_ais") == 0) | (F.col("termination_oduk") > 0)))


def _regen_counts(flow: DataFrame, typed: DataFrame) -> DataFrame:
    alarm, at = F.upper("alarm"), F.col("ftype")
    f = flow.join(typed.select("board", "ftype", "kind"), "board")
    otuk, oduk = S.alarm_family(F.col("alarm")) == "OTUk", alarm.contains("ODUK")
    g = f.groupBy("root").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(otuk).alias("otuk"), F.count_if(oduk).alias("oduk"), F.count_if(F.col("kind").startswith("REGEN")).alias("at_regen"),
        F.count_if(at == "OTUk-RegenIn").alias("n_in"), F.count_if(at == "OTUk-RegenOut").alias("n_out"), F.count_if((at == "OTUk-RegenIn") & alarm.rlike("OTUK|R_LOS|LOF")).alias("in_otuk"),
        F.count_if((at == "OTUk-RegenOut") & alarm.contains("AIS")).alias("out_ais"), F.count_if((at == "ODUk-Termination") & oduk).alias("term_oduk"),
    )
    return g.join(typed.select(F.col("board").alias("root"), F.col("ftype").alias("root_type")), "root")


def regen_issues(flow: DataFrame, typed: DataFrame) -> DataFrame:
    """What breaks the rules of regenerators, a row an issue: root, check, board, alarm, issue.

    1: an OTUk alarm that came over the regenerator's boundary to an electrical board. 2: an optical failure whose flow meets
    regenerators, but no OTUk alarm at an ingress. 3: an optical failure with an AIS at an egress, but no ODUk alarm at a
    termination. 4: an OTUk loss that came over the boundary to a relay. Checks 2 and 3 are about a flow, so they name no board.
    """
    f = flow.join(typed.select("board", "ftype"), "board").filter((F.col("board") != F.col("root")) & F.col("edge_type").contains("regen_boundary"))
    place = F.concat(F.col("board").cast("string"), F.lit("/"), F.col("alarm"))
    row = lambda n, text: [F.col("root"), F.lit(n).alias("check"), "board", "alarm", F.concat(F.lit(text), place).alias("issue")]
    one = f.filter(F.col("ftype").isin("ODUk-Termination", "ODUk-Creation") & (S.alarm_family(F.col("alarm")) == "OTUk")).select(*row(1, "OTUk alarm over the regenerator at electrical board: "))
    four = f.filter((F.col("ftype") == "OTUk-Relay") & F.upper("alarm").rlike("OTUK_LOS|OTUK_LOF")).select(*row(4, "OTUk alarm over the regenerator at relay: "))
    g = _regen_counts(flow, typed).filter(F.col("root_type") == "OTUk-Relay")
    told = lambda n, text: ["root", F.lit(n).alias("check"), F.lit(None).cast("long").alias("board"), F.lit(None).cast("string").alias("alarm"), F.lit(text).alias("issue")]
    two = g.filter("n_in + n_out > 0 and in_otuk = 0").select(*told(2, "optical failure without an OTUk alarm at the ingress"))
    three = g.filter("n_out > 0 and out_ais > 0 and term_oduk = 0").select(*told(3, "AIS at the egress without an ODUk alarm at a termination"))
    return one.unionByName(two).unionByName(three).unionByName(four)


def regen_status(flow: DataFrame, typed: DataFrame) -> DataFrame:
    """Per root: its type, alarms in all, by family, at regenerators and at terminations, issues, and PASS or FAIL."""
    found = regen_issues(flow, typed).groupBy("root").agg(F.count(F.lit(1)).alias("issues"))
    g = _regen_counts(flow, typed).join(found, "root", "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    return g.select("root", "root_type", "total", "otuk", "oduk", "at_regen", "term_oduk", "issues", F.when(F.col("issues") == 0, "PASS").otherwise("FAIL").alias("status"))


def distinct_failures(failures: DataFrame, lasts_ms: int = 15_000) -> DataFrame:
    """Failures once by board, event, time, duration and role: rows without a board drop out, no duration is ``lasts_ms``, an event that
    forces a role has it, else the one given counts, else that of the board's kind."""
    event = F.coalesce("event", F.lit(""))
    forced = F.when(event.isin("Line_Disconnect", "XCON_Port_Down", "XCON_Buffer_Overflow", "XCON_Fabric_Fault"), "SRC")
    of_kind = F.when(F.col("kind").isin("TRIB", "XCON", "LINE"), "SRC").otherwise("RELAY")
    role = F.coalesce(forced, F.nullif(S.normalize_role(F.coalesce("role", F.lit(""))), F.lit("")), of_kind)
    lasts = F.coalesce(F.floor(F.col("duration_ms").cast("double")), F.lit(lasts_ms)).cast("long")
    df = failures.filter("board is not null")
    return df.select("board", event.alias("event"), "time", lasts.alias("duration_ms"), role.alias("role")).distinct()
