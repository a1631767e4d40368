"""DuckDB twins of queries that SQL can express on whole tables."""

from __future__ import annotations

from roadframe.llm import chat, quality

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT = f"""
WITH t AS (SELECT doc_id, {LOWERED} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


def quality_features(source: str = "documents") -> str:
    """Items of a WITH list that end in `f` (doc_id and all features) and `v` (doc_id and votes)."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def count(pattern: str) -> str:
        return f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"

    RUNS = r"##+|\*\*+|\$\$+|%%+|&&+|!!+"
    votes = []
    for rule, (ratio, bad, good) in quality.RULES.items():
        a, b = (x.strip() for x in ratio.split("/"))
        value = f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"
        votes.append(f"CASE WHEN {value} {bad} THEN 0 WHEN {value} {good} THEN 1 END AS {rule}")
    return f"""d AS (SELECT doc_id, coalesce(text, '') AS t FROM {source}),
w AS MATERIALIZED (SELECT doc_id, t, CASE WHEN trim(t, {space}) = '' THEN [] ELSE string_split_regex(trim(t, {space}), '[\\x20\\x09-\\x0D]+') END AS words,
      [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(n - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM twice) GROUP BY doc_id),
f AS MATERIALIZED (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, {count('[#*$%&|<>]')} AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
      len(list_distinct(words)) AS n_distinct, {count(chr(92) + 'p{Lu}')} AS n_upper, {count('!')} AS n_exclaim,
      len([x FOR x IN lines IF regexp_matches(x, '[.!?:;")][\\x20\\x09-\\x0D]*\\z')]) AS n_ended, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS n_alnum, {count(chr(92) + '|')} AS n_pipes, {count(RUNS)} AS n_run_chars
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
v AS MATERIALIZED (SELECT doc_id, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed, {', '.join(votes)} FROM f)"""


def quality_rounds(rounds: int = quality.ROUNDS) -> str:
    """Further items: the histogram and one row of estimates per round, the last named `estimate`."""
    rules = list(quality.RULES)
    names = ", ".join(rules)
    items = [f"hist AS MATERIALIZED (SELECT {names}, CAST(count(*) AS DOUBLE) AS n FROM v WHERE NOT failed GROUP BY {names})",
             "e0 AS (SELECT CAST({p} AS DOUBLE) AS prior, {r})".format(
                 p=quality.PRIOR, r=", ".join(f"CAST({quality.START[0]} AS DOUBLE) AS {x}_g, CAST({quality.START[1]} AS DOUBLE) AS {x}_b" for x in rules))]

    def share(top: str, bottom: str, least: float = 1e-6) -> str:
        return f"least(greatest(round((coalesce(sum({top}), 0) + 1) / (coalesce(sum({bottom}), 0) + 2), 6), {least}), 1 - 1e-6)"

    for k in range(rounds):
        one = ", ".join(f"{share(f'CASE WHEN {x} = 1 THEN good END', f'CASE WHEN {x} IS NOT NULL THEN good END', quality.FLOOR[0])} AS {x}_g, "
                        f"{share(f'CASE WHEN {x} = 0 THEN bad END', f'CASE WHEN {x} IS NOT NULL THEN bad END', quality.FLOOR[1])} AS {x}_b" for x in rules)
        items.append(f"h{k} AS (SELECT hist.*, n * p AS good, n * (1 - p) AS bad FROM (SELECT hist.*, {posterior()} AS p FROM hist, e{k} AS e) AS hist)")
        items.append(f"e{k + 1} AS MATERIALIZED (SELECT {share('good', 'n')} AS prior, {one} FROM h{k})")
    return ",\n".join(items) + f",\nestimate AS (SELECT * FROM e{rounds})"


def posterior(votes: str = "hist") -> str:
    terms = " + ".join(f"CASE {votes}.{x} WHEN 1 THEN ln(e.{x}_g / (1 - e.{x}_b)) WHEN 0 THEN ln((1 - e.{x}_g) / e.{x}_b) ELSE 0 END" for x in quality.RULES)
    return f"1 / (1 + exp(-(ln(e.prior / (1 - e.prior)) + {terms})))"


QUALITY = f"""WITH {quality_features()},
{quality_rounds()}
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
       NOT failed AND {posterior('v')} >= {quality.THRESHOLD} AS kept
FROM f JOIN v ON f.doc_id = v.doc_id, estimate AS e
"""

CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
    regexp_replace(coalesce(text, ''), '<\\|(im_start|im_end)\\|>', '< |\\1| >', 'g') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (SELECT t.*, p.perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
    FROM t JOIN p ON t.conv_id = p.conv_id),
h AS (SELECT *, '{chat.START}' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || regexp_replace(regexp_replace(speaker, '<\\|(im_start|im_end)\\|>', '< |\\1| >', 'g'), '[\\n\\r]', ' ', 'g') ELSE '' END || chr(10) AS head FROM s),
z AS (SELECT *, head || body || '{chat.END}' || chr(10) AS segment FROM h),
o AS (SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS position,
    CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM z WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, body))
SELECT conv_id, perspective, position, turn, speaker, chat_role, segment, start, start + length(segment) AS "end",
    start + CASE WHEN chat_role = 'assistant' THEN length(head) ELSE length(segment) END AS mask_start,
    start + length(segment) - CASE WHEN chat_role = 'assistant' THEN 1 ELSE 0 END AS mask_end
FROM o
"""

NEAR = f"""
WITH RECURSIVE t AS (SELECT doc_id, trim({LOWERED}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, CASE WHEN t = '' THEN [] ELSE string_split_regex(t, '[\\x20\\x09-\\x0D]+') END AS words FROM t),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS s
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM w UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.seen),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""
