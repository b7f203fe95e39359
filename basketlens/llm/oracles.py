"""SQL for the registered queries, to be run by DuckDB on the same files."""

from __future__ import annotations

from basketlens.llm import quality
from basketlens.llm.queries import TRICKY, URL_RULES

SPLIT = r"'[\x20\x09-\x0D]+'"
BLANKS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), {SPLIT}), lambda x: x <> '')"


def _quality(risk: float = 0.02, delta: float = 0.05) -> str:
    rules = quality.RULES
    longest = max(len(r.cutoffs) for r in rules)
    tests = ", ".join(
        f"({i}, " + ", ".join(f"CAST({r.cutoffs[i] if i < len(r.cutoffs) else r.cutoffs[-1]!r} AS DOUBLE)" for r in rules) + ")"
        for i in range(longest)
    )
    names = ", ".join(f"c_{r.name}" for r in rules)
    strict = " OR ".join(f"coalesce({r.score} > c_{r.name}, false)" for r in rules)
    return f"""
    WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang, text, {WORDS} AS ws FROM documents),
    grams AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS g
              FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
    rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, range(0, 5) AS r(j) GROUP BY rid),
    ln AS (SELECT rid, l FROM (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM w)
           WHERE trim(l, {BLANKS}) <> ''),
    lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM ln GROUP BY rid),
    m AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::BIGINT AS n_symbols,
             coalesce(lc.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             coalesce(lc.n_lines, 0)::BIGINT AS n_lines,
             len(ws) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(ws) AS base_failed
          FROM w LEFT JOIN rep USING (rid) LEFT JOIN lc USING (rid)),
    good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
    tests AS (SELECT * FROM (VALUES {tests}) v(step, {names})),
    x AS (SELECT lang, step, count(*) AS n, count(*) FILTER ({strict}) AS x
          FROM m JOIN good USING (doc_id), tests t WHERE NOT base_failed GROUP BY ALL),
    p AS (SELECT *, CASE WHEN x >= n * {risk!r} THEN 1 ELSE list_sum(list_transform(range(0, x + 1),
            lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r})))) END AS p,
            (SELECT count(*) FROM (SELECT DISTINCT lang FROM x)) AS strata FROM x),
    stops AS (SELECT lang, min(step) FILTER (p > {delta!r} / strata) AS stop FROM p GROUP BY ALL),
    chosen AS (SELECT p.lang, max(step) AS step FROM p JOIN stops s ON p.lang IS NOT DISTINCT FROM s.lang
               WHERE stop IS NULL OR step < stop GROUP BY ALL),
    judged AS (SELECT m.*, t.* FROM m LEFT JOIN chosen c ON c.lang IS NOT DISTINCT FROM m.lang LEFT JOIN tests t USING (step))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT ({strict}) AS kept FROM judged"""


_MIX = f"""
    WITH sized AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '-42'), 1, 15))::BIGINT AS h FROM documents),
    src AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * z AS cap
            FROM (SELECT source, sum(size)::BIGINT AS z FROM sized GROUP BY source)),
    levels AS (SELECT *, (sum(z) OVER ())::HUGEINT - coalesce(sum(cap) OVER o, 0)::HUGEINT AS lft,
                 sum(w) OVER (ORDER BY cap / w, source NULLS LAST
                              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS opn
               FROM src WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    clamps AS (SELECT *, cap::HUGEINT * opn <= lft * w AS clamped FROM levels),
    tgt AS (SELECT source, z, CASE WHEN clamped THEN cap::DOUBLE ELSE
              (w * (SELECT arg_max(lft, opn) FROM clamps WHERE NOT clamped))::DOUBLE
              / (SELECT max(opn) FROM clamps WHERE NOT clamped)::DOUBLE END AS target FROM clamps),
    wholes AS (SELECT *, CASE WHEN z > 0 THEN floor(target / z) ELSE 0 END::BIGINT AS n FROM tgt),
    run AS (SELECT s.*, t.z, t.target, t.n, t.target - t.n * t.z AS missing,
              sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
              sum(size) OVER (PARTITION BY s.source, h) AS here
            FROM sized s JOIN wholes t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, z AS source_size, target,
      (size * (n + CASE WHEN 2 * (upto - here) + here <= 2 * missing THEN 1 ELSE 0 END))::BIGINT AS taken FROM run"""


ALNUM = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _windows(table: str, key: str) -> str:
    """Words of a table's texts, and its windows of each length an item has."""
    lowered = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return (
        f"SELECT row_number() OVER () AS rid, {key}, "
        f"list_filter(string_split_regex({lowered}, {ALNUM}), lambda x: x <> '') AS ws FROM {table}"
    )


_LEAKS = f"""
    WITH d AS MATERIALIZED ({_windows("documents", "doc_id")}), b AS ({_windows("benchmark", "item_id")}),
    item AS (SELECT item_id, n, array_to_string(ws[i:i+n-1], ' ') AS g FROM
      (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
       FROM (SELECT *, least(len(ws), 10) AS n FROM b WHERE len(ws) > 0))),
    doc AS (SELECT rid, n, i, array_to_string(ws[i:i+n-1], ' ') AS g FROM
      (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
       FROM d, (SELECT DISTINCT n FROM item) WHERE len(ws) >= n)),
    hit AS MATERIALIZED (SELECT rid, i, n, item_id FROM doc JOIN item USING (n, g)),
    covered AS (SELECT rid, count(DISTINCT j) AS c FROM
      (SELECT rid, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
    items AS (SELECT rid, count(*) AS c, string_agg(item, ',' ORDER BY item) AS l FROM
      (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(covered.c, 0)::BIGINT AS n_hit,
      coalesce(items.c, 0)::BIGINT AS n_items, sha256(coalesce(items.l, '')) AS items_sha256,
      covered.c IS NOT NULL AS contaminated
    FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)"""


_LINES = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
    k AS (SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS key FROM l),
    f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10)
    SELECT any_value(k.doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN f ON k.key = f.key GROUP BY rid"""


_URLS = f"""
    WITH rules AS (SELECT host, path, verdict FROM ({URL_RULES})),
    p AS (SELECT row_number() OVER () AS rid, page_id,
      translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
      coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    fits AS (SELECT rid, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
               arg_max(r.verdict, length(r.host || r.path)) AS verdict
             FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
             GROUP BY rid)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fits USING (rid)"""


_CHAT = rf"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-1, 0, 'user', '{TRICKY}'), (-1, 1, 'assistant', '{TRICKY}')),
    e AS (SELECT *, regexp_matches(role || chr(0) || text, '<\|im_start\|>|<\|im_end\|>|<\\+\|')
                    OR regexp_matches(role, '\n|<\|n\|>') AS conflict,
            len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|'))
              + 4 * len(regexp_extract_all(role, '\n')) AS more FROM c)
    SELECT conv_id, count(*)::BIGINT AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(24 + length(role) + length(text) + CASE WHEN conflict THEN more ELSE 0 END)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id"""


def statements() -> dict[str, str]:
    return {
        "op1_quality_rules": _quality(),
        "op2_mix_sources": _MIX,
        "op3_decontaminate": _LEAKS,
        "op4_line_dedup": _LINES,
        "op9_url_filters": _URLS,
        "op13_chat_format": _CHAT,
    }
