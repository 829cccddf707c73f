"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidegauge.llm.decontaminate import CONTAINMENT, SHINGLE
from tidegauge.llm.line_dedup import LEAST_CHARS, SHORT_SITES, SITES
from tidegauge.llm.quality import FREE_LINES, FREE_WORDS, LEAST_GROUP, MEASURES, TWO_SIDED, WINDOW

_BLANK = r"[ \t\n\x0b\x0c\r]+"

_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}'), lambda x:x <> '')"


def _quality() -> str:
    slack = " ".join(f"WHEN '{m}' THEN {s}" for m, (s, _) in MEASURES.items())
    widths = " ".join(f"WHEN '{m}' THEN {w}" for m, (_, w) in MEASURES.items())
    values = " UNION ALL ".join(f"SELECT row, lang, source, '{m}' AS measure, {m} AS v FROM measures" for m in MEASURES)
    two_sided = ", ".join(f"'{m}'" for m in TWO_SIDED)

    def fences(level: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        ranked = f"SELECT {by}measure, bucket, sum(n) AS n FROM sketch GROUP BY {by}measure, bucket"
        return f"""{level} AS (
            SELECT {by}measure, max(total) AS docs, {", ".join(f"min(CASE WHEN up_to * 10 >= total * {q} THEN bucket END) AS d{q}" for q in (1, 5, 9))}
            FROM (SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS up_to, sum(n) OVER (PARTITION BY {by}measure) AS total FROM ({ranked}))
            GROUP BY {by}measure)"""

    return rf"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
    l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x:regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS ls FROM d),
    pos AS (SELECT row, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d WHERE len(w) >= {WINDOW}),
    win AS (SELECT row, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM pos),
    twice AS (SELECT row, g FROM win GROUP BY row, g HAVING count(*) > 1),
    held AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM win JOIN twice USING (row, g)) GROUP BY row),
    c AS (SELECT l.row, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
            length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
            len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM l LEFT JOIN held ON l.row = held.row),
    measures AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed, n_symbols * 1000 // greatest(word_chars, 1) AS symbol_rate,
            n_upper * 1000 // greatest(word_chars, 1) AS upper_rate, greatest(n_dup_lines - {FREE_LINES}, 0) * 1000 // greatest(n_lines, 1) AS duplicate_line_rate,
            greatest(n_repeat_words - {FREE_WORDS}, 0) * 1000 // greatest(n_words, 1) AS repeat_rate, word_chars * 100 // greatest(n_words, 1) AS word_length FROM c),
    vals AS ({values}),
    good AS (SELECT vals.* FROM vals JOIN measures USING (row) WHERE NOT base_failed),
    cut AS (SELECT *, greatest(length(bin(v::BIGINT)) - 6, 0)::INT AS s FROM good),
    sketch AS (SELECT lang, source, measure, ((v::BIGINT >> s) << s) AS bucket, count(*) AS n FROM cut GROUP BY ALL),
    {fences("f0", "lang, source")}, {fences("f1", "lang")}, {fences("f2", "")},
    told AS (SELECT vals.row, vals.measure, v,
            {", ".join(f"CASE WHEN f0.docs >= {LEAST_GROUP} THEN f0.d{q} WHEN f1.docs >= {LEAST_GROUP} THEN f1.d{q} ELSE f2.d{q} END AS d{q}" for q in (1, 5, 9))}
        FROM vals LEFT JOIN f0 ON vals.measure = f0.measure AND vals.lang IS NOT DISTINCT FROM f0.lang AND vals.source IS NOT DISTINCT FROM f0.source
        LEFT JOIN f1 ON vals.measure = f1.measure AND vals.lang IS NOT DISTINCT FROM f1.lang LEFT JOIN f2 ON vals.measure = f2.measure),
    judged AS (SELECT *, CASE measure {slack} END AS slack, CASE measure {widths} END AS widths FROM told),
    out AS (SELECT row, bool_or(coalesce(v > d9 + (d9 - d5) * widths + slack, false) OR (measure IN ({two_sided}) AND coalesce(v < d1 - (d5 - d1) * widths - slack, false))) AS outside
        FROM judged GROUP BY row)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
        n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT outside AS kept FROM measures JOIN out USING (row)"""


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAKS = rf"""
    WITH bw AS (SELECT item_id, w, least(len(w), {SHINGLE}) AS k FROM (SELECT item_id, list_filter(regexp_split_to_array({_LOW}, '{_BLANK}'), lambda x:x <> '') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
    dw AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '{_BLANK}'), lambda x:x <> '') AS w FROM documents WHERE text IS NOT NULL),
    b AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM bw)),
    d AS (SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM
        (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw JOIN (SELECT DISTINCT k FROM bw) ON len(w) >= k)),
    sizes AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
    SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, n::BIGINT AS n_shingles, count(*) / n AS containment
    FROM b JOIN d USING (k, g) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= {CONTAINMENT} * n - 1e-9"""

_STRIP = r"trim({x}, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
_LINES = f"""
    WITH l AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents),
    held AS (SELECT {_STRIP.format(x="x")} AS line, coalesce('s' || source, 'none') AS site, text FROM (SELECT source, text, unnest(ls) AS x FROM l)),
    bad AS (SELECT coalesce(list(line), []) AS lines FROM (SELECT line FROM held WHERE line <> '' GROUP BY line
        HAVING least(count(DISTINCT site), count(DISTINCT text)) >= CASE WHEN length(line) < {LEAST_CHARS} THEN {SHORT_SITES} ELSE {SITES} END)),
    k AS (SELECT doc_id, text, ls, list_filter(ls, lambda x: NOT list_contains(lines, {_STRIP.format(x="x")})) AS rest FROM l CROSS JOIN bad)
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(rest, chr(10)), '') END AS text, coalesce(len(ls), 0)::BIGINT AS n_lines,
        coalesce(len(ls) - len(rest), 0)::BIGINT AS n_removed FROM k"""

SQL: dict[str, str] = {"op2_quality": _quality(), "op3_decontaminate": _LEAKS, "op4_line_dedup": _LINES}
