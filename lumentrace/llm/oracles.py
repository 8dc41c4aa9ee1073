"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import chat_format, license_scan, line_rules, mixing, url_filter

_WS = r"[\x20\x09-\x0D]+"
_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{_WS}'), lambda w: w <> '')"


def _quote(text: str) -> str:
    return text.replace("'", "''")


def op1() -> str:
    """Rules, seeds and unrolled rounds of propagation."""
    how = url_filter.Propagation()
    fits = "CASE "
    for text, says in sorted(url_filter.RULES, key=lambda r: -len(r[0])):
        name, prefix = text.split("/", 1)
        fits += f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{prefix}') THEN '{text}={says}' "
    fits += "END"
    host = r"translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = _quote(url_filter.LINK)
    rounds = ""
    for k in range(how.rounds):
        rounds += f""", s{k + 1} AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (SELECT * FROM s0
UNION ALL SELECT e.dst, e.w * s.trust * {how.damping}, 0 FROM e JOIN s{k} s ON s.host = e.src
UNION ALL SELECT e.src, 0, e.w * s.distrust * {how.damping} FROM e JOIN s{k} s ON s.host = e.dst) GROUP BY host)"""
    return f"""WITH r AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, html, coalesce({host}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
u AS (SELECT page_id, html, host, path, {fits} AS hit FROM h), v AS (SELECT *, nullif(split_part(hit, '=', 1), '') AS rule, nullif(split_part(hit, '=', 2), '') AS says FROM u),
g AS (SELECT host, avg(CASE WHEN says = 'allow' THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN says = 'block' THEN 1.0 ELSE 0.0 END) AS b FROM v GROUP BY host),
s0 AS (SELECT host, CASE WHEN a >= {how.seed_share} THEN a ELSE 0.0 END AS trust, CASE WHEN b >= {how.seed_share} THEN b ELSE 0.0 END AS distrust FROM g),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM v),
c AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst AND src <> '' GROUP BY src, dst), e AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM c){rounds}
SELECT page_id, v.host, path, rule, coalesce(says, CASE WHEN round(distrust, 9) - round(trust, 9) >= {how.threshold} THEN 'block' ELSE 'allow' END) AS verdict, round(trust, 9) AS trust, round(distrust, 9) AS distrust
FROM v LEFT JOIN s{how.rounds} s ON v.host = s.host"""


def op2() -> str:
    """All pairs of paragraphs and templates, and all passages of those whose sets meet, without an order of words."""
    import math

    seps = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places = ", ".join(
        f"list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f"w[i + {k}] = '{word}'" for k, word in enumerate(p.split()))}) AS p{n}" for n, (p, _) in enumerate(license_scan.PHRASES)
    )
    labels = ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, (_, label) in enumerate(license_scan.PHRASES))
    every = " || ".join(f"p{n}" for n in range(len(license_scan.PHRASES)))
    rows = ", ".join(f"({t[0]}, '{t[1]}', {t[2]}, {', '.join(map(str, license_scan.needed(t, license_scan.THRESHOLD)))})" for t in license_scan.template_sets())
    return f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{seps}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {places} FROM d), q AS (SELECT doc_id, n_words, {every} AS places, list_filter([{labels}], lambda x: x IS NOT NULL) AS base FROM p),
t AS (SELECT * FROM (VALUES {rows}) v(i, label, words, need, l)),
b AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '\\n[\\x20\\x09\\x0B-\\x0D]*\\n')) AS block FROM documents),
s AS (SELECT doc_id, list_filter(regexp_split_to_array(block, '{seps}'), lambda x: x <> '') AS w FROM b),
r AS (SELECT doc_id, label, len(words) AS n, need, list_max(list_transform(range(1, len(w) + 1), lambda i: len(list_intersect(w[i:i + l - 1], words)))) AS o FROM s JOIN t ON len(list_intersect(w, words)) >= need),
m AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(o / n) AS score FROM r WHERE o >= need GROUP BY doc_id)
SELECT q.doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, (list_min(places) - 1)::BIGINT AS first_word, (list_max(places) - 1)::BIGINT AS last_word,
array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') AS labels,
CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score FROM q LEFT JOIN m ON q.doc_id = m.doc_id"""


def op5() -> str:
    rules = line_rules.LineRules()
    plain = line_rules.PLAIN
    fails = f"""(length(regexp_replace(x, '{plain}', '', 'g')) * 100 > length(x) * {rules.max_punctuation} OR regexp_matches(x, '{_quote(line_rules.NAV_TRAIL)}') OR regexp_matches(x, '{_quote(line_rules.NAV_LABEL)}')
OR (length(x) <= {rules.furniture_chars} AND regexp_matches(x, '{_quote(line_rules.FURNITURE)}')))"""
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS body, {_words("text")} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5), gg AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM gg WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(body, '{_quote(line_rules.SYMBOLS)}', '', 'g'))::BIGINT AS n_symbols,
(len(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, array_to_string(list_filter(lines, lambda x: NOT {fails}), chr(10)) AS clean FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
k AS (SELECT *, n_words < {rules.min_words} OR n_repeat_words * 100 > n_words * {rules.max_repeat} AS base_failed, (word_chars - length(regexp_replace(clean, '{_WS}', '', 'g')))::BIGINT AS lost_chars FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars * 100 <= word_chars * {rules.max_lost} AS kept, lost_chars FROM k"""


def op8() -> str:
    t = chat_format.Template()
    esc = "replace(replace({}, '&', '&amp;'), '<|', '&lt;|')"
    roles = ", ".join(f"'{r}'" for r in t.loss_roles)
    moves = " ".join(f"WHEN s = '{a}' AND r = '{b}' THEN '{c}'" for (a, b), c in t.moves.items())
    said = "<|im_end|><|im_start|>assistant ok"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{said}'), (-1, 1, 'assistant', '{said}')),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256, coalesce(string_agg(text, '' {order}) FILTER (role IN ({roles})), '') AS learned,
sum({len(t.start) + len(t.after_role) + len(t.end)} + length(replace({esc.format("role")}, chr(10), '&#10;')) + length({esc.format("text")}))::BIGINT AS formatted_chars, list(role {order}) AS roles FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars,
list_reduce(['start'] || roles, lambda s, r: CASE {moves} ELSE 'error' END) IN ({", ".join(f"'{x}'" for x in t.final)}) AS valid FROM g"""


def op10(seed: int = 11) -> str:
    cap = mixing.CAP
    weights = "[" + ", ".join(f"{w}::DOUBLE" for w in mixing.WEIGHTS) + "]"
    unit = "('0x' || substring(md5({}), 1, 8))::BIGINT"
    return f"""WITH n AS (SELECT greatest(1, ceil(count(*) / {mixing.PER_SALT}))::BIGINT AS salts FROM documents),
d AS (SELECT doc_id, source, len({_words("text")})::BIGINT AS size FROM documents), b AS (SELECT *, floor(sqrt(size))::BIGINT AS bucket, coalesce({unit.format("doc_id::VARCHAR")} % salts, 0) AS salt FROM d, n),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source), w AS (SELECT *, {weights}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS w FROM s),
r AS (SELECT *, source_size * {cap} / w AS ratio FROM w), l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * {cap}) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
 / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level <= ratio), t AS (SELECT source, source_size, least(source_size * {cap}, f.level * w)::DOUBLE AS target FROM l, f),
k AS (SELECT doc_id, b.source, size, source_size, target, row_number() OVER (PARTITION BY b.source ORDER BY bucket, salt, size, doc_id) AS k, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
 {unit.format(f"'{seed} ' || (b.source IS NULL)::VARCHAR || ' ' || coalesce(b.source, '')")} / 4294967296.0::DOUBLE AS o FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (least(floor(o + k * each) - floor(o + (k - 1) * each), {cap}) * size)::BIGINT AS taken FROM k"""


ORACLES: dict[str, str] = {
    "op1_url_filter": op1(),
    "op2_license_scan": op2(),
    "op5_line_rules": op5(),
    "op8_chat_format": op8(),
    "op10_mixing": op10(),
}
