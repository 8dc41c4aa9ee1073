"""Scalar functions of the domain, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOARD = r"^(ROADM\d+)-([A-Za-z0-9]*?[A-Za-z])(\d+)\$(\d+)"
#: Board kinds by prefix, longest first where one begins another.
PREFIXES = ("REGENIN", "REGENOUT", "TRIBUTARY", "TRIB", "XCON", "LINE", "FIU", "SC2", "OA", "OD", "OM")
EVENTS = ("Fiber_Aging", "Fiber_Crack", "Fiber_Cut", "Line_Disconnect", "XCON_Port_Down", "XCON_Buffer_Overflow", "XCON_Fabric_Fault")
EVENT_CATEGORY = {e: e.split("_")[0] for e in EVENTS}
#: Aliases of event names, lower case.
EVENT_ALIASES = {"port_down": "XCON_Port_Down", "buffer_overflow": "XCON_Buffer_Overflow", "fabric_fault": "XCON_Fabric_Fault", "cut": "Fiber_Cut", "crack": "Fiber_Crack", "aging": "Fiber_Aging", "disconnect": "Line_Disconnect"}
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def board_name(node: Column, kind: Column, index: Column) -> Column:
    """``ROADM<node>-<kind><index, three digits at least>$0``."""
    return F.concat(F.lit("ROADM"), node.cast("string"), F.lit("-"), kind, pad(index.cast("string"), 3), F.lit("$0"))


def fixed(x: Column, digits: int) -> Column:
    """``x`` with ``digits`` (0 to 7) places, rounded by its exact binary value, ties to even.

    The product with a power of ten is taken with its rounding error (from two halves of the number, whose products are exact),
    which says on what side of the middle the value lies. Numbers beyond 1e8 have the formatter's rounding.
    """
    scale, a = F.lit(float(10**digits)), F.abs(x.cast("double"))
    product, spread = a * scale, a * 134217729.0
    high = spread - (spread - a)
    error = (high * scale - product) + (a - high) * scale
    down = F.floor(product)
    beyond = (product - down - 0.5) + error
    number = down + F.when((beyond > 0) | ((beyond == 0) & (down % 2 == 1)), 1).otherwise(0)
    text = pad(number.cast("string"), digits + 1)
    if digits:
        text = F.regexp_replace(text, f"(\\d{{{digits}}})$", ".$1")
    text = F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), text)
    return F.when(F.isnan(x) | (a >= 1e8), F.format_string(f"%.{digits}f", x.cast("double"))).otherwise(text)


def pad(digits: Column, width: int) -> Column:
    """Zeros in front; longer numbers stay whole."""
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def parse_board(name: Column) -> dict[str, Column]:
    """Node name, kind and index of a board name; kind UNKNOWN and the rest null if it has another form."""
    fits = name.rlike(BOARD)
    raw = F.upper(F.regexp_extract(name, BOARD, 2))
    return {
        "node": F.when(fits, F.regexp_extract(name, BOARD, 1)),
        "kind": F.when(fits, board_kind(raw)).otherwise("UNKNOWN"),
        "index": F.when(fits, F.regexp_extract(name, BOARD, 3).cast("int")),
    }


def board_kind(raw: Column) -> Column:
    out = F.lit("UNKNOWN")
    for p in reversed(PREFIXES):
        out = F.when(F.upper(raw).startswith(p), "TRIB" if p == "TRIBUTARY" else p).otherwise(out)
    return out


def function_type(kind: Column, role: Column) -> Column:
    return (
        F.when(F.upper(role) == "SRC", "ODUk-Creation")
        .when(F.upper(role).isin("TERMINATION", "SNK"), "ODUk-Termination")
        .when(kind == "REGENIN", "OTUk-RegenIn")
        .when(kind == "REGENOUT", "OTUk-RegenOut")
        .when(kind.isin("TRIB", "XCON", "LINE"), "ODUk-Creation")
        .otherwise("OTUk-Relay")
    )


def board_category(kind: Column) -> Column:
    return F.when(kind.isin("OA", "OD", "OM", "FIU", "SC2", "REGENIN", "REGENOUT"), "Fiber").when(kind == "XCON", "XCON").when(kind.isin("LINE", "TRIB"), "Line").otherwise("unknown")


def normalize_board_id(name: Column) -> Column:
    """Index padded to three digits (five for regenerators), slot ``$0`` added if missing."""
    form = r"^(ROADM\d+)-([A-Za-z0-9]*?[A-Za-z])(\d+)(\$\d+)?$"
    kind, digits = F.regexp_extract(name, form, 2), F.regexp_extract(name, form, 3)
    padded = F.when(F.upper(kind).startswith("REGEN"), pad(digits, 5)).otherwise(pad(digits, 3))
    slot = F.regexp_extract(name, form, 4)
    fixed = F.concat(F.regexp_extract(name, form, 1), F.lit("-"), kind, padded, F.when(slot == "", "$0").otherwise(slot))
    return F.when(name.rlike(form), fixed).otherwise(name)


ROLE = r"-(SRC|RELAY|TERMINATION|ODUk-Creation|ODUk-[Tt]ermination)$"


def split_role(token: Column) -> tuple[Column, Column]:
    role = F.regexp_extract(token, ROLE, 1)
    named = F.when(role == "ODUk-Creation", "SRC").when(F.lower(role) == "oduk-termination", "TERMINATION").otherwise(role)
    return F.regexp_replace(token, ROLE, ""), named


def normalize_role(role: Column) -> Column:
    r = F.upper(F.trim(role))
    return F.when(r.isin("SRC", "SOURCE", "CREATION", "ODUK-CREATION"), "SRC").when(r.isin("SNK", "SINK", "TERMINATION", "ODUK-TERMINATION", "DST"), "SNK").when(r.isin("RELAY", "TRANSIT", "PASS"), "RELAY").otherwise("")


def role_for_kind(kind: Column) -> Column:
    return F.when(kind.isin("TRIB", "XCON", "LINE"), "SRC").when(kind.isin("OA", "OD", "OM", "FIU", "REGENIN", "REGENOUT"), "RELAY").otherwise("SNK")


def edge_type(a: Column, b: Column) -> Column:
    return F.when((a == "REGENIN") & (b == "REGENOUT"), "regen_boundary").otherwise(F.concat(a, F.lit("_"), b))


def layer_of_type(ftype: Column) -> Column:
    return F.when(ftype.contains("OTUk") | ftype.contains("Relay"), "optical").otherwise("electrical")


def severity_of_alarm(alarm: Column) -> Column:
    return F.when(alarm.rlike("(?i)LOS|LOF|AIS"), "Critical").when(alarm.rlike("(?i)BDI"), "Major").when(alarm.rlike("(?i)DEG"), "Minor").otherwise("")


def alarm_family(alarm: Column) -> Column:
    return F.when(alarm.rlike("(?i)OTUK|R_LOS|LOF|LOM"), "OTUk").otherwise("ODUk")


def event_category(event: Column) -> Column:
    return F.coalesce(F.element_at(_map(EVENT_CATEGORY), event), F.lit("unknown"))


def normalize_event(name: Column) -> Column:
    """Canonical event by exact name, else by name or alias in any case; null if unknown."""
    known = {e.lower(): e for e in EVENTS} | EVENT_ALIASES
    return F.when(name.isin(*EVENTS), name).otherwise(F.element_at(_map(known), F.lower(F.replace(F.trim(name), F.lit(" "), F.lit("_")))))


def parse_time(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS], F.timestamp_seconds(text.try_cast("double")))


def parse_step_seconds(text: Column) -> Column:
    """``1s``, ``500ms``, ``2`` as whole seconds, 1 at least and by default."""
    n = F.regexp_extract(text, r"^\s*(\d+)\s*(ms|s)?\s*$", 1).try_cast("long")
    return F.greatest(F.lit(1).cast("long"), F.coalesce(F.when(text.rlike("ms"), F.floor(n / 1000)).otherwise(n), F.lit(1)))


def segment_id(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b).cast("string"), F.lit("-"), F.greatest(a, b).cast("string"))


def side_from_index(index: Column) -> Column:
    return F.when(F.pmod(index - 1, F.lit(4)) < 2, 1).otherwise(2)


def ses_flag(es: Column) -> Column:
    return F.when(es > 0.5, 1).otherwise(0)


def alarm_gain(alarm: Column, at_regen: Column) -> Column:
    a = F.upper(alarm)
    return F.when(a.contains("AIS"), 2.0).when(a.contains("BDI"), 0.7).when(at_regen & (alarm_family(alarm) == "OTUk"), 0.1).otherwise(1.0)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


#: Lines of an answer that name its event, and what stands before its board.
EVENT_LINES = (r"[Rr]oot\s*[Cc]ause.*", r"[Ee]vent\s*:\s*.*", r"[Ff]ailure\s*[Tt]ype\s*:\s*.*", r"[Rr]oot\s*[Ee]vent\s*:\s*.*")
BOARD_LINES = (r"[Bb]oard\s*:\s*", r"[Rr]oot\s*[Cc]ause\s*[Bb]oard\s*:\s*", r"[Pp]eak[_ ]?board\s*:\s*", r"[Ss]ource[_ ]?[Bb]oard\s*:\s*", "")


def event_in_text(text: Column) -> Column:
    """First known event near a root-cause or event line, then anywhere, then in any case; the list's order breaks ties."""

    def first(hay: Column, up: bool = False) -> Column:
        out = F.lit(None).cast("string")
        for e in reversed(EVENTS):
            name = e.upper() if up else e
            out = F.when(hay.contains(name) | hay.contains(name.replace("_", " ")), e).otherwise(out)
        return out

    # What is searched is computed once, not for every event.
    of = lambda hay, up=False: F.get(F.transform(F.array(hay), lambda h: first(h, up)), F.lit(0))
    return F.coalesce(*[of(F.regexp_extract(text, p, 0)) for p in EVENT_LINES], first(text), of(F.upper(text), True))


def board_in_text(text: Column) -> Column:
    board = r"(ROADM\d+-\w+\$\d+)"
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p + board, 1), F.lit("")) for p in BOARD_LINES])


def feature_in_text(text: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"\b{name}=([^\s,;]+)", 1), F.lit(""))


def answer_in_text(text: Column) -> Column:
    return F.trim(F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)ANSWER:\s*(.*)", 1), F.lit("")), text))
