"""DuckDB oracle SQL for every registered query.

Each query repeats the fixture derivation of ``parlance.sources.fixtures``
in plain SQL (CTEs below) and then the operator's semantics, written
independently of the Spark code. Views ``conversations`` etc. are provided
by the caller.
"""

from __future__ import annotations

from parlance.sources.fixtures import BASE_EPOCH, CATEGORY_ROWS, CONV_STEP, FILE_CONVERSATIONS, TURN_STEP

TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11)"


def fmt_sql(expr: str, pattern: str = "%Y-%m-%d %H:%M") -> str:
    return f"strftime(make_timestamp(CAST({expr} AS BIGINT) * 1000000), '{pattern}')"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _cat_values() -> str:
    rows = []
    for i, (slug, name, desc, kws) in enumerate(CATEGORY_ROWS):
        kw = "[" + ", ".join(q(k) for k in kws) + "]::VARCHAR[]"
        rows.append(f"({i}, {q(slug)}, {q(name)}, {q(desc)}, {kw})")
    return ",\n    ".join(rows)


MESSAGES = f"""messages AS (
  SELECT conv_id, turn AS pos, role, trim(text, {TRIM}) AS content,
         CAST({BASE_EPOCH} + conv_id * {CONV_STEP} + turn * {TURN_STEP} AS DOUBLE) AS ts
  FROM conversations
  WHERE role IN ('user', 'assistant') AND trim(text, {TRIM}) <> ''
)"""

HEADERS = f"""headers AS (
  SELECT conv_id, 'Conversation ' || CAST(conv_id AS VARCHAR) AS title,
         CAST({BASE_EPOCH} + conv_id * {CONV_STEP} AS DOUBLE) AS create_time,
         max(ts) AS update_time,
         count(*) AS message_count,
         count(*) FILTER (WHERE role = 'user') AS user_messages
  FROM messages GROUP BY conv_id HAVING count(*) >= 2
)"""

CATS = f"""cats(cat_ord, slug, name, description, keywords) AS (
  VALUES
    {_cat_values()}
)"""

# Keyword labels (J7) for every header row.
KEYWORD = """firsts AS (
  SELECT conv_id, string_agg(content, ' ' ORDER BY pos) AS texts
  FROM (SELECT conv_id, pos, content,
               row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS rn
        FROM messages WHERE role = 'user') WHERE rn <= 5
  GROUP BY conv_id
),
hay AS (
  SELECT h.conv_id, lower(h.title || ' ' || coalesce(f.texts, '')) AS haystack
  FROM headers h LEFT JOIN firsts f USING (conv_id)
),
hits AS (
  SELECT DISTINCT hay.conv_id, c.cat_ord, c.slug
  FROM hay, cats c, unnest(c.keywords) AS k(kw)
  WHERE c.slug <> 'other' AND contains(hay.haystack, lower(k.kw))
),
kwlabels AS (
  SELECT hay.conv_id,
         coalesce((SELECT list(slug ORDER BY cat_ord) FROM hits WHERE hits.conv_id = hay.conv_id), ['other']) AS categories
  FROM hay
)"""

STATE = f"""state AS (
  SELECT h.conv_id, h.title,
         {fmt_sql('h.create_time')} AS created,
         {fmt_sql('h.update_time')} AS updated,
         h.message_count, h.user_messages, k.categories,
         CASE WHEN h.conv_id % 5 = 0 THEN []::VARCHAR[]
              ELSE ['topic-' || CAST(h.conv_id % 7 AS VARCHAR), 'size-' || CAST(h.message_count AS VARCHAR)] END AS tags,
         CASE WHEN h.conv_id % 5 = 0 THEN '' ELSE 'Summary of conversation ' || CAST(h.conv_id AS VARCHAR) END AS summary,
         CASE WHEN h.conv_id % 5 = 0 THEN []::VARCHAR[]
              WHEN h.conv_id % 2 = 0 THEN ['First fact of ' || CAST(h.conv_id AS VARCHAR), 'Second fact of ' || CAST(h.conv_id AS VARCHAR)]
              ELSE ['First fact of ' || CAST(h.conv_id AS VARCHAR)] END AS key_facts,
         ((h.conv_id * 37) % 101) / 100.0 AS relevance_score
  FROM headers h JOIN kwlabels k USING (conv_id)
  WHERE h.conv_id % 4 <> 0
)"""

# Hydrated, labelled pool after min_messages = 4 (J1 with label defaults).
LABELLED = """labelled AS (
  SELECT h.*, coalesce(s.categories, ['other']) AS categories, coalesce(s.tags, []::VARCHAR[]) AS tags,
         coalesce(s.summary, '') AS summary, coalesce(s.key_facts, []::VARCHAR[]) AS key_facts,
         coalesce(s.relevance_score, 0.5) AS relevance_score
  FROM headers h JOIN state s USING (conv_id)
  WHERE h.message_count >= 4
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"



BASE = (MESSAGES, HEADERS, CATS, KEYWORD)


def dround(expr: str, dp: int) -> str:
    """Half-up rounding on the decimal text, as Spark's round on doubles."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38, 10)), {dp}) AS DOUBLE)"


SQL: dict[str, str] = {}

SQL["keyword_breakdown"] = with_(*BASE) + f"""
SELECT slug, CAST(count(*) AS BIGINT) AS conversations, {dround('avg(0.5)', 2)} AS avg_relevance,
       CAST(count(*) FILTER (WHERE 0.5 >= 0.7) AS BIGINT) AS high_relevance
FROM kwlabels k JOIN headers h USING (conv_id), unnest(k.categories) AS u(slug)
WHERE h.message_count >= 4
GROUP BY slug
"""

POOL = """pool AS (SELECT * FROM headers WHERE message_count >= 4)"""

HYD = """hyd AS (
  SELECT h.*,
    CASE WHEN s.conv_id IS NULL THEN []::VARCHAR[] ELSE coalesce(s.categories, ['other']) END AS categories,
    CASE WHEN s.conv_id IS NULL THEN []::VARCHAR[] ELSE coalesce(s.tags, []::VARCHAR[]) END AS tags,
    CASE WHEN s.conv_id IS NULL THEN '' ELSE coalesce(s.summary, '') END AS summary,
    CASE WHEN s.conv_id IS NULL THEN []::VARCHAR[] ELSE coalesce(s.key_facts, []::VARCHAR[]) END AS key_facts,
    CASE WHEN s.conv_id IS NULL THEN 0.0::DOUBLE ELSE coalesce(s.relevance_score, 0.5) END AS relevance_score
  FROM pool h LEFT JOIN state s ON h.conv_id = s.conv_id
)"""

SHYD = """shyd AS (
  SELECT h.*,
    CASE WHEN s.conv_id IS NULL THEN []::VARCHAR[] ELSE coalesce(s.categories, []::VARCHAR[]) END AS categories,
    CASE WHEN s.conv_id IS NULL THEN 0.0::DOUBLE ELSE coalesce(s.relevance_score, 0.0) END AS relevance_score
  FROM pool h LEFT JOIN state s ON h.conv_id = s.conv_id
)"""

LAB = """labelled AS (SELECT * FROM hyd WHERE len(categories) > 0)"""

FULL = BASE + (STATE, POOL, HYD, LAB)

IDS = f"""opts(opt_ord, opt) AS (VALUES (0, '5, 3'), (1, ' 12 '), (2, ','), (3, '5'), (4, '99999999')),
split_opts AS (SELECT opt_ord, string_split(opt, ',') AS parts FROM opts),
id_parts AS (SELECT opt_ord, parts, unnest(generate_series(1, len(parts))) AS i FROM split_opts),
ids AS (SELECT CAST(opt_ord AS INTEGER) AS opt_ord, CAST(i - 1 AS INTEGER) AS part_ord, CAST(trim(parts[i], {TRIM}) AS BIGINT) AS conv_id
        FROM id_parts WHERE trim(parts[i], {TRIM}) <> '')"""


def odistinct(expr: str) -> str:
    """Order-preserving distinct of a list (first occurrences)."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def idx_rows(src: str, title: str = "title") -> str:
    return f"""SELECT CAST(conv_id AS VARCHAR) AS id, {title} AS title, {fmt_sql('create_time')} AS created,
       {fmt_sql('update_time')} AS updated, message_count AS messages, user_messages FROM {src}"""


SQL["message_counts"] = with_(MESSAGES, HEADERS) + "SELECT conv_id, message_count, user_messages FROM headers WHERE message_count >= 4"

SQL["parse_summary"] = with_(MESSAGES, HEADERS) + f"""
SELECT count(*) AS total,
       count(*) FILTER (WHERE message_count >= 4) AS after_filter,
       count(*) FILTER (WHERE message_count < 4) AS skipped,
       {fmt_sql('min(create_time) FILTER (WHERE message_count >= 4)')} AS oldest,
       {fmt_sql('max(create_time) FILTER (WHERE message_count >= 4)')} AS newest,
       CAST({dround('CAST(sum(message_count) FILTER (WHERE message_count >= 4) AS DOUBLE) / count(*) FILTER (WHERE message_count >= 4)', 0)} AS BIGINT) AS avg_messages
FROM headers"""

SQL["newest_n"] = with_(MESSAGES, HEADERS) + f"""
SELECT conv_id, title, {fmt_sql('create_time')} AS created FROM headers WHERE message_count >= 4
ORDER BY create_time DESC, conv_id LIMIT 10"""

SQL["first_user_messages"] = with_(MESSAGES) + """
SELECT conv_id, pos, content, user_rank FROM (
  SELECT conv_id, pos, content, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS user_rank
  FROM messages WHERE role = 'user') WHERE user_rank <= 5"""

SQL["keyword_label"] = with_(*BASE) + """
SELECT conv_id, array_to_string(categories, '|') AS categories, CAST(0.5 AS DOUBLE) AS relevance_score FROM kwlabels"""

SQL["label_counts"] = with_(*FULL) + """
SELECT slug, count(*) AS conversations FROM labelled, unnest(categories) AS u(slug) GROUP BY slug"""

SQL["state_hydrate"] = with_(*FULL) + """
SELECT conv_id, array_to_string(categories, '|') AS categories, array_to_string(tags, '|') AS tags, summary,
       array_to_string(key_facts, '|') AS key_facts, relevance_score FROM hyd"""

SQL["resume_worklist"] = with_(*FULL) + """
SELECT conv_id, title FROM pool
WHERE conv_id NOT IN (SELECT conv_id FROM state WHERE summary <> '' OR len(tags) > 0)"""

SQL["cached_list"] = with_(*FULL) + """
SELECT conv_id, 'model' AS mode FROM pool WHERE conv_id IN (SELECT conv_id FROM state WHERE summary <> '' OR len(tags) > 0)
UNION ALL
SELECT conv_id, 'keywords' AS mode FROM pool WHERE conv_id IN (SELECT conv_id FROM state)"""

SQL["filter_pool"] = with_(*FULL) + """
SELECT conv_id, relevance_score,
       row_number() OVER (ORDER BY relevance_score DESC, create_time DESC, conv_id) AS position
FROM labelled WHERE list_contains(categories, 'english') AND relevance_score >= 0.3"""

SQL["by_ids"] = with_(*FULL, IDS) + """
SELECT conv_id, relevance_score FROM labelled WHERE conv_id IN (SELECT conv_id FROM ids)"""

SQL["ordered_lookup"] = with_(MESSAGES, HEADERS, IDS) + """
SELECT ids.opt_ord, ids.part_ord, ids.conv_id, h.title, h.conv_id IS NOT NULL AS found
FROM ids LEFT JOIN headers h ON ids.conv_id = h.conv_id"""

SQL["missing_ids"] = with_(MESSAGES, HEADERS, IDS) + """
SELECT ids.opt_ord, ids.part_ord, ids.conv_id FROM ids LEFT JOIN headers h ON ids.conv_id = h.conv_id WHERE h.conv_id IS NULL"""

SQL["corpus_stats"] = with_(*BASE, STATE) + f"""
, agg AS (
  SELECT count(*) AS raw,
         count(*) FILTER (WHERE message_count >= 4) AS filtered,
         count(*) FILTER (WHERE message_count >= 4 AND s.conv_id IS NOT NULL) AS labelled,
         CAST(coalesce(sum(message_count) FILTER (WHERE message_count >= 4), 0) AS BIGINT) AS total_messages
  FROM headers h LEFT JOIN (SELECT conv_id FROM state) s ON h.conv_id = s.conv_id)
SELECT raw, filtered, labelled, filtered - labelled AS unlabelled, total_messages,
       CAST({dround('CAST(total_messages AS DOUBLE) / greatest(1, filtered)', 0)} AS BIGINT) AS avg_messages FROM agg"""

SQL["category_breakdown"] = with_(*BASE, STATE, POOL, SHYD) + f"""
SELECT slug, count(*) AS conversations, {dround('avg(relevance_score)', 2)} AS avg_relevance,
       count(*) FILTER (WHERE relevance_score >= 0.7) AS high_relevance
FROM shyd, unnest(categories) AS u(slug) GROUP BY slug"""

SQL["relevance_histogram"] = with_(*BASE, STATE, POOL, SHYD) + """
, bins(bin_ord, bin) AS (VALUES (0, '0.0-0.2'), (1, '0.2-0.4'), (2, '0.4-0.6'), (3, '0.6-0.8'), (4, '0.8-1.0')),
scored AS (
  SELECT CASE WHEN relevance_score < 0.2 THEN '0.0-0.2' WHEN relevance_score < 0.4 THEN '0.2-0.4'
              WHEN relevance_score < 0.6 THEN '0.4-0.6' WHEN relevance_score < 0.8 THEN '0.6-0.8'
              ELSE '0.8-1.0' END AS bin
  FROM shyd WHERE relevance_score > 0),
cnt AS (SELECT bin, count(*) AS n FROM scored GROUP BY bin)
SELECT b.bin_ord, b.bin, CAST(coalesce(cnt.n, 0) AS BIGINT) AS conversations
FROM bins b LEFT JOIN cnt ON b.bin = cnt.bin WHERE (SELECT count(*) FROM scored) > 0"""

SQL["category_index"] = with_(*FULL) + f"""
, st AS (SELECT slug, count(*) AS count, {dround('avg(relevance_score)', 3)} AS avg_relevance
         FROM labelled, unnest(list_distinct(categories)) AS u(slug) GROUP BY slug)
SELECT c.slug, c.name, CAST(coalesce(st.count, 0) AS BIGINT) AS count, coalesce(st.avg_relevance, 0.0::DOUBLE) AS avg_relevance
FROM cats c LEFT JOIN st ON c.slug = st.slug"""

SQL["exported_total"] = with_(*FULL) + """
SELECT count(DISTINCT conv_id) AS total_conversations
FROM labelled, unnest(categories) AS u(slug) WHERE slug IN (SELECT slug FROM cats)"""

OLD_INDEX = f"""old_index AS ({idx_rows("headers WHERE message_count <= 6", "'Old ' || title")}),
new_index AS ({idx_rows("pool")})"""

SQL["index_upsert"] = with_(MESSAGES, HEADERS, POOL, OLD_INDEX) + """
SELECT * FROM old_index WHERE id NOT IN (SELECT id FROM new_index)
UNION ALL SELECT * FROM new_index"""

SQL["index_delta"] = with_(MESSAGES, HEADERS, POOL, OLD_INDEX) + """
SELECT count(*) FILTER (WHERE n.id IS NOT NULL AND o.id IS NULL) AS added,
       count(*) FILTER (WHERE n.id IS NOT NULL AND o.id IS NOT NULL) AS updated,
       count(*) AS total
FROM (SELECT DISTINCT id FROM new_index) n FULL OUTER JOIN (SELECT DISTINCT id FROM old_index) o ON n.id = o.id"""

SQL["point_lookup"] = with_(MESSAGES, HEADERS) + "SELECT conv_id, title, message_count FROM headers WHERE conv_id = 1"

SQL["pick_category"] = with_(*FULL) + """
SELECT conv_id, slug, c.name AS category_name FROM labelled, unnest(categories) AS u(slug) JOIN cats c USING (slug)
WHERE slug = 'german'"""

SQL["index_rows"] = with_(MESSAGES, HEADERS, POOL) + idx_rows("pool")

SQL["membership_rows"] = with_(*FULL) + """
SELECT conv_id, slug, c.name AS category_name FROM labelled, unnest(categories) AS u(slug) JOIN cats c USING (slug)"""

SQL["rounding_clamp"] = with_(MESSAGES, HEADERS) + f"""
, v AS (SELECT conv_id, message_count, CAST(conv_id % 13 AS DOUBLE) / 8.0 - 0.5 AS raw FROM headers)
SELECT conv_id,
       greatest(0.0, least(1.0, raw)) AS clamped,
       CASE WHEN conv_id % 3 = 0 THEN 0.5::DOUBLE ELSE greatest(0.0, least(1.0, raw)) END AS clamped_default,
       {dround('CAST(message_count AS DOUBLE) / 8.0', 0)} AS r0,
       {dround('CAST(message_count AS DOUBLE) / 8.0', 2)} AS r2,
       {dround('CAST(conv_id AS DOUBLE) / 16.0', 3)} AS r3
FROM v"""

SQL["array_merge_ops"] = with_(*BASE, STATE) + f"""
SELECT conv_id,
       array_to_string({odistinct('list_concat(categories, tags)')}, '|') AS merged,
       array_to_string({odistinct('list_concat(categories, categories)')}, '|') AS distinct_cats,
       array_to_string(tags, ', ') AS tag_list
FROM state"""

SQL["stratified_sample"] = with_(MESSAGES, HEADERS, POOL) + """
, ranked AS (SELECT conv_id, row_number() OVER (ORDER BY create_time DESC, conv_id) - 1 AS p FROM pool),
cnt AS (SELECT count(*) AS n FROM ranked),
pos AS (SELECT t.i AS sample_ord, least((2 * t.i * cnt.n + 10) // 20, cnt.n - 1) AS sample_pos FROM range(10) t(i), cnt)
SELECT conv_id, sample_ord FROM ranked JOIN pos ON ranked.p = pos.sample_pos WHERE (SELECT n FROM cnt) > 10
UNION ALL SELECT conv_id, p AS sample_ord FROM ranked WHERE (SELECT n FROM cnt) <= 10"""

SQL["review_queue"] = with_(*FULL) + """
SELECT conv_id, row_number() OVER (ORDER BY relevance_score DESC, create_time DESC, conv_id) AS position,
       count(*) OVER () AS total, relevance_score
FROM labelled WHERE relevance_score >= 0.0"""

# ---------------------------------------------------------------- pairs / enhance
NL = "chr(10)"
NL2 = "chr(10) || chr(10)"


def pairs_cte(src: str = "messages", name: str = "pairs") -> str:
    return f"""{name}_tagged AS (
  SELECT conv_id, pos, role, content,
         CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (
           PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pair_index
  FROM {src}),
{name} AS (
  SELECT conv_id, pair_index,
         coalesce(string_agg(content, {NL2} ORDER BY pos) FILTER (WHERE role = 'user'), '') AS "user",
         coalesce(max(content) FILTER (WHERE role = 'assistant'), '(no reply)') AS assistant
  FROM {name}_tagged GROUP BY conv_id, pair_index)"""


def snip(c: str) -> str:
    return f"CASE WHEN length({c}) > 80 THEN substring({c}, 1, 79) || '…' ELSE {c} END"


LPAIRS = pairs_cte("(SELECT * FROM messages WHERE conv_id IN (SELECT conv_id FROM labelled))", "lpairs")

ONE_LINERS = f"""ol AS (
  SELECT conv_id, pair_index, {snip('"user"')} AS user_snippet, {snip('assistant')} AS assistant_snippet,
         CASE WHEN conv_id % 10 = 3 AND pair_index >= 3 THEN '(no summary)'
              WHEN conv_id % 6 = 0 AND pair_index % 3 = 0
                THEN 'Revised exchange ' || pair_index || ' of conversation ' || conv_id
              WHEN (conv_id + pair_index) % 4 = 0 THEN '(no summary)'
              ELSE 'Exchange ' || pair_index || ' of conversation ' || conv_id END AS one_liner
  FROM lpairs WHERE conv_id % 9 <> 0)"""

FLAGS = f"""fl AS (
  SELECT o.conv_id, h.title, h.message_count,
         string_agg(o.pair_index || ': ' || o.one_liner || {NL}, '' ORDER BY o.pair_index) AS digest
  FROM ol o JOIN headers h ON o.conv_id = h.conv_id GROUP BY o.conv_id, h.title, h.message_count),
rlist AS (
  SELECT conv_id, list_concat(
      [{{'s': 0, 'e': 1, 'ok': true}}],
      CASE WHEN conv_id % 2 = 0 THEN [{{'s': 1, 'e': message_count, 'ok': true}}] ELSE [] END,
      CASE WHEN conv_id % 5 = 0 THEN [{{'s': 2, 'e': 0, 'ok': true}}] ELSE [] END,
      CASE WHEN conv_id % 7 = 0 THEN [{{'s': 2, 'e': 3, 'ok': false}}] ELSE [] END,
      CASE WHEN conv_id % 10 = 0 THEN [{{'s': 0, 'e': 1, 'ok': true}}] ELSE [] END) AS items
  FROM fl WHERE conv_id % 17 <> 0),
rx AS (SELECT conv_id, items, unnest(generate_series(1, len(items))) AS k FROM rlist),
ranges AS (
  SELECT conv_id, CAST(k - 1 AS BIGINT) AS range_ord, CAST(items[k].s AS BIGINT) AS start, CAST(items[k].e AS BIGINT) AS "end"
  FROM rx WHERE items[k].ok)"""

SLICES = """sl AS (
  SELECT r.conv_id, r.range_ord, r.start, r."end", p.pair_index, p."user", p.assistant
  FROM ranges r JOIN lpairs p ON r.conv_id = p.conv_id AND p.pair_index >= r.start AND p.pair_index <= r."end")"""

EXPAND = f"""ep AS (
  SELECT s.conv_id, s.range_ord, s.start || '-' || s."end" AS range_key,
         'Stretch of ' || h.title || ', items ' || s.start || '-' || s."end" || {NL2}
         || string_agg('asked: ' || s."user" || {NL} || 'answered: ' || s.assistant || {NL2}, '' ORDER BY s.pair_index) AS prompt
  FROM sl s JOIN headers h ON s.conv_id = h.conv_id
  GROUP BY s.conv_id, s.range_ord, s.start, s."end", h.title),
ex AS (
  SELECT conv_id, range_key, min(range_ord) AS first_ord,
         arg_max(CASE WHEN conv_id % 8 = 3 AND range_ord = 0 THEN '(Expansion failed for this range.)'
                      ELSE 'Notes on exchanges ' || range_key || ' (range ' || range_ord || ') of conversation ' || conv_id || '.' END,
                 range_ord) AS text
  FROM ep GROUP BY conv_id, range_key),
exo AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first_ord) - 1 AS BIGINT) AS entry_pos, range_key, text FROM ex)"""

PROPOSE = f"""pp AS (
  SELECT l.conv_id, 'Entry ' || l.title || {NL} || 'summary = ' || l.summary || {NL}
         || 'facts = ' || CAST(to_json(l.key_facts) AS VARCHAR) || {NL} || 'tags = ' || CAST(to_json(l.tags) AS VARCHAR) || {NL2}
         || 'Notes' || {NL}
         || (SELECT string_agg(x.range_key || ' = ' || x.text || {NL}, '' ORDER BY x.entry_pos) FROM exo x WHERE x.conv_id = l.conv_id) AS prompt
  FROM labelled l WHERE l.conv_id IN (SELECT conv_id FROM exo)),
prop AS (
  SELECT l.conv_id, l.summary, l.key_facts, l.tags,
         CASE WHEN l.conv_id % 3 = 0 THEN 'Summary of conversation ' || l.conv_id ELSE 'Improved summary of ' || l.conv_id END AS new_summary,
         CASE WHEN l.conv_id % 2 = 0 THEN ['First fact of ' || l.conv_id, 'Second fact of ' || l.conv_id]
              ELSE ['New fact of ' || l.conv_id] END AS new_facts,
         CASE WHEN l.conv_id % 5 = 1 THEN []::VARCHAR[] ELSE ['tag-' || l.conv_id] END AS new_tags
  FROM labelled l WHERE l.conv_id IN (SELECT conv_id FROM pp)),
diff AS (
  SELECT conv_id, summary, key_facts, tags, new_summary, new_facts, new_tags,
         new_summary <> '' AND new_summary <> summary AS d_s,
         len(new_facts) > 0 AND new_facts <> key_facts AS d_f,
         len(new_tags) > 0 AND new_tags <> tags AS d_t
  FROM prop)"""

ENH = (*FULL, LPAIRS, ONE_LINERS)

SQL["message_pairs"] = with_(MESSAGES, pairs_cte()) + 'SELECT conv_id, pair_index, "user", assistant FROM pairs'

SQL["pair_chunks"] = with_(MESSAGES, pairs_cte()) + "SELECT conv_id, pair_index, CAST(pair_index // 3 AS BIGINT) AS chunk FROM pairs"

SQL["pair_prompts"] = with_(*FULL, LPAIRS) + f"""
SELECT 'pairs:' || conv_id || ':' || (pair_index // 3) AS prompt_id, conv_id, CAST(pair_index // 3 AS BIGINT) AS chunk,
       'Items ' || string_agg(CAST(pair_index AS VARCHAR), ', ' ORDER BY pair_index) || {NL2}
       || string_agg('<item ' || pair_index || '>' || {NL} || 'asked: ' || "user" || {NL} || 'answered: ' || assistant || {NL} || '</item>' || {NL}, '' ORDER BY pair_index) AS prompt
FROM lpairs GROUP BY conv_id, pair_index // 3"""

SQL["one_liners"] = with_(*ENH) + "SELECT conv_id, pair_index, user_snippet, assistant_snippet, one_liner FROM ol"

SQL["flag_prompts"] = with_(*ENH, FLAGS) + f"""
SELECT 'flag:' || conv_id AS prompt_id, conv_id,
       'Index of ' || title || {NL2} || digest AS prompt
FROM fl"""

SQL["flag_ranges"] = with_(*ENH, FLAGS) + 'SELECT conv_id, range_ord, start, "end" FROM ranges'

SQL["range_slices"] = with_(*ENH, FLAGS, SLICES) + 'SELECT conv_id, range_ord, start, "end", pair_index FROM sl'

SQL["expand_prompts"] = with_(*ENH, FLAGS, SLICES, EXPAND) + """
SELECT 'expand:' || conv_id || ':' || range_ord AS prompt_id, conv_id, range_ord, range_key, prompt FROM ep"""

SQL["expansions"] = with_(*ENH, FLAGS, SLICES, EXPAND) + "SELECT conv_id, entry_pos, range_key, text FROM exo"

SQL["proposal_prompts"] = with_(*ENH, FLAGS, SLICES, EXPAND, PROPOSE) + "SELECT 'propose:' || conv_id AS prompt_id, conv_id, prompt FROM pp"

SQL["proposal_diff"] = with_(*ENH, FLAGS, SLICES, EXPAND, PROPOSE) + """
SELECT conv_id,
       CASE WHEN d_s THEN summary END AS summary_old, CASE WHEN d_s THEN new_summary END AS summary_new,
       CASE WHEN d_f THEN array_to_string(key_facts, '|') END AS key_facts_old,
       CASE WHEN d_f THEN array_to_string(new_facts, '|') END AS key_facts_new,
       CASE WHEN d_t THEN array_to_string(tags, '|') END AS tags_old,
       CASE WHEN d_t THEN array_to_string(new_tags, '|') END AS tags_new
FROM diff WHERE d_s OR d_f OR d_t"""

SQL["apply_proposals"] = with_(*ENH, FLAGS, SLICES, EXPAND, PROPOSE) + """
, acc AS (
  SELECT conv_id,
         conv_id % 2 = 0 AND (d_s OR d_f) AS take_a, conv_id % 3 <> 0 AND d_t AS take_b,
         d_s, d_f, new_summary, new_facts, new_tags
  FROM diff),
st AS (
  SELECT s.conv_id,
         CASE WHEN a.take_a AND a.d_s THEN a.new_summary ELSE s.summary END AS summary,
         CASE WHEN a.take_a AND a.d_f THEN a.new_facts ELSE s.key_facts END AS key_facts,
         CASE WHEN a.take_b THEN a.new_tags ELSE s.tags END AS tags
  FROM state s LEFT JOIN acc a ON s.conv_id = a.conv_id),
en AS (
  SELECT o.conv_id,
         CASE WHEN a.take_a AND a.d_s THEN a.new_summary ELSE l.summary END AS summary,
         CASE WHEN a.take_a AND a.d_f THEN a.new_facts ELSE l.key_facts END AS key_facts,
         CASE WHEN a.take_b THEN a.new_tags ELSE l.tags END AS tags
  FROM (SELECT DISTINCT conv_id FROM ol) o JOIN labelled l ON o.conv_id = l.conv_id LEFT JOIN acc a ON o.conv_id = a.conv_id)
SELECT 'state' AS table_name, conv_id, summary, array_to_string(key_facts, '|') AS key_facts, array_to_string(tags, '|') AS tags FROM st
UNION ALL
SELECT 'enhanced' AS table_name, conv_id, summary, array_to_string(key_facts, '|') AS key_facts, array_to_string(tags, '|') AS tags FROM en"""

SQL["enhance_worklist"] = with_(*ENH) + """
SELECT DISTINCT l.conv_id FROM labelled l, unnest(l.categories) AS u(slug)
WHERE slug IN (SELECT slug FROM cats)
  AND l.conv_id NOT IN (SELECT o.conv_id FROM ol o JOIN headers h ON o.conv_id = h.conv_id WHERE h.message_count <= 5)"""

# ---------------------------------------------------------------- rendering
GEN = "2024-06-01 00:00:00"
LONG = "%d %b %Y %H:%M"


def numtext(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


def stars_sql(x: str) -> str:
    return f"repeat('★', CAST(round({x} * 5) AS INTEGER))"


def lines_sql(*parts: str) -> str:
    return f"array_to_string(list_concat({', '.join(parts)}), chr(10))"


def facts_sql(c: str) -> str:
    return f"list_transform({c}, lambda f: '- ' || f)"


def when_list(cond: str, lst: str) -> str:
    return f"CASE WHEN {cond} THEN {lst} ELSE []::VARCHAR[] END"


MEM = """mem AS (SELECT l.*, u.slug FROM labelled l, unnest(l.categories) AS u(slug) WHERE u.slug IN (SELECT slug FROM cats))"""

MD_BODY = lines_sql(
    f"['## ' || title, '', '| Field | Value |', '|-------|-------|', '| Created | ' || {fmt_sql('create_time')} || ' |', "
    f"'| Updated | ' || {fmt_sql('update_time')} || ' |', '| Messages | ' || message_count || ' (' || user_messages || ' from user) |', "
    f"'| Relevance | ' || {numtext('relevance_score')} || ' ' || {stars_sql('relevance_score')} || ' |', "
    f"'| Categories | ' || array_to_string(categories, ', ') || ' |']",
    when_list("len(tags) > 0", "['| Tags | ' || array_to_string(tags, ', ') || ' |']"),
    "['']",
    when_list("summary <> ''", "['**Summary**: ' || summary, '']"),
    when_list("len(key_facts) > 0", f"list_concat(['**Key facts**:'], {facts_sql('key_facts')}, [''])"),
    "['---', '']")

SQL["category_markdown"] = with_(*FULL, MEM) + f"""
SELECT slug, 1 AS part, relevance_score, create_time, conv_id, {MD_BODY} AS block FROM mem
UNION ALL
SELECT m.slug, 0 AS part, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT,
       {lines_sql("['# ' || c.name, '', 'Exported: " + GEN + "', 'Conversations: ' || count(*), '', '---', '']")}
FROM mem m JOIN cats c ON m.slug = c.slug GROUP BY m.slug, c.name"""

SQL["category_json"] = with_(*FULL, MEM) + f"""
SELECT slug, conv_id, CAST(conv_id AS VARCHAR) AS id, title, {fmt_sql('create_time')} AS created, {fmt_sql('update_time')} AS updated,
       message_count, user_messages, array_to_string(categories, '|') AS categories, array_to_string(tags, '|') AS tags,
       summary, array_to_string(key_facts, '|') AS key_facts, relevance_score FROM mem"""

CTX_BODY = lines_sql(
    f"['## ' || title, '', '**Date**: ' || {fmt_sql('create_time')} || ' | **Relevance**: ' || {numtext('relevance_score')} "
    f"|| ' | **Messages**: ' || message_count, '']",
    when_list("summary <> ''", "['**Summary**: ' || summary, '']"),
    when_list("len(key_facts) > 0", f"list_concat(['**Key facts & decisions**:'], {facts_sql('key_facts')}, [''])"),
    when_list("len(tags) > 0", "['**Tags**: ' || array_to_string(tags, ', '), '']"),
    "['---', '']")

SQL["context_package"] = with_(*FULL, MEM) + f"""
SELECT slug, 1 AS part, relevance_score, create_time, conv_id, {CTX_BODY} AS block FROM mem WHERE relevance_score >= 0.3
UNION ALL
SELECT m.slug, 0 AS part, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT,
       {lines_sql("['# Context Package: ' || c.name, '', 'Generated: " + GEN + "', 'Conversations: ' || count(*) FILTER (WHERE m.relevance_score >= 0.3), 'Minimum relevance: 0.3', '', '---', '']")}
FROM mem m JOIN cats c ON m.slug = c.slug GROUP BY m.slug, c.name"""

ENH_BODY = lines_sql(
    f"['## ' || title, '', '**Date**: ' || {fmt_sql('create_time')} || ' | **Updated**: ' || {fmt_sql('update_time')} "
    f"|| ' | **Relevance**: ' || {numtext('relevance_score')} || ' | **Messages**: ' || message_count, '']",
    when_list("summary <> ''", "['**Summary**: ' || summary, '']"),
    when_list("len(key_facts) > 0", f"list_concat(['**Key Facts & Decisions**:'], {facts_sql('key_facts')}, [''])"),
    when_list("len(tags) > 0", "['**Tags**: ' || array_to_string(tags, ', '), '']"),
    when_list("len(coalesce(digest, [])) > 0", "list_concat(['**Conversation Digest** *(message-pair one-liners)*:', ''], digest, [''])"),
    when_list("len(coalesce(deep, [])) > 0", "list_concat(['**Deep-Dive Sections**:', ''], deep)"),
    "['---', '']")

SQL["enhanced_package"] = with_(*ENH, FLAGS, SLICES, EXPAND, MEM) + f"""
, dg AS (SELECT conv_id, list((pair_index + 1) || '. ' || one_liner ORDER BY pair_index) AS digest FROM ol GROUP BY conv_id),
dd AS (SELECT conv_id, flatten(list(['### Exchanges ' || (CAST(split_part(range_key, '-', 1) AS INTEGER) + 1) || '–'
                                     || (CAST(split_part(range_key, '-', 2) AS INTEGER) + 1), '', text, ''] ORDER BY entry_pos)) AS deep
       FROM exo GROUP BY conv_id),
em AS (SELECT m.*, dg.digest, dd.deep FROM mem m LEFT JOIN dg ON m.conv_id = dg.conv_id LEFT JOIN dd ON m.conv_id = dd.conv_id)
SELECT slug, 1 AS part, relevance_score, create_time, conv_id, {ENH_BODY} AS block FROM em WHERE relevance_score >= 0.3
UNION ALL
SELECT m.slug, 0 AS part, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT,
       {lines_sql("['# Enhanced Context Package: ' || c.name, '', 'Generated: " + GEN + "', 'Conversations: ' || count(*) FILTER (WHERE m.relevance_score >= 0.3), 'Minimum relevance: 0.3', '', '---', '']")}
FROM mem m JOIN cats c ON m.slug = c.slug GROUP BY m.slug, c.name"""


def safe_sql(title: str, fallback: str) -> str:
    kept = f"regexp_replace({title}, '[^\\w\\s-]', '', 'g')"
    coll = f"regexp_replace(trim({kept}, {TRIM}), '\\s+', '_', 'g')"
    return f"coalesce(nullif(substring({coll}, 1, 80), ''), CAST({fallback} AS VARCHAR))"


SQL["transcripts"] = with_(MESSAGES, HEADERS) + f"""
SELECT h.conv_id, 0 AS part, CAST(-1 AS BIGINT) AS pos,
       '# ' || h.title || chr(10) || chr(10) || '_Created: ' || {fmt_sql('h.create_time', LONG)} || '_' || chr(10) || chr(10) || '---' || chr(10) AS block,
       {safe_sql('h.title', 'h.conv_id')} || '_' || h.conv_id || '.md' AS file_name
FROM headers h
UNION ALL
SELECT m.conv_id, 1 AS part, m.pos,
       {lines_sql("[CASE WHEN m.role = 'user' THEN '### 🧑 User' ELSE '### 🤖 Assistant' END]",
                  when_list("m.ts > 0", "['_' || " + fmt_sql('m.ts', LONG) + " || '_']"),
                  "['', m.content, '', '---', '']")} AS block,
       {safe_sql('h.title', 'h.conv_id')} || '_' || h.conv_id || '.md' AS file_name
FROM messages m JOIN headers h ON m.conv_id = h.conv_id"""


def condensed_sql(max_chars: int) -> str:
    head, tail = int(max_chars * 0.6), int(max_chars * 0.35)
    cap = "CASE WHEN length(content) > 1500 THEN substring(content, 1, 1500) || ' [...]' ELSE content END"
    return with_(MESSAGES, HEADERS) + f"""
, ct AS (
  SELECT h.conv_id, '# ' || h.title || chr(10) || chr(10)
         || string_agg('[' || upper(m.role) || ']: ' || {cap} || chr(10), chr(10) ORDER BY m.pos) AS t
  FROM headers h JOIN messages m ON h.conv_id = m.conv_id GROUP BY h.conv_id, h.title)
SELECT conv_id, CASE WHEN length(t) > {max_chars}
                     THEN substring(t, 1, {head}) || chr(10) || chr(10) || '[... middle truncated ...]' || chr(10) || chr(10)
                          || substring(t, length(t) - {tail} + 1, {tail})
                     ELSE t END AS condensed
FROM ct"""


SQL["condensed_text"] = condensed_sql(8000)
SQL["condensed_short"] = condensed_sql(600)

SQL["snippets"] = with_(MESSAGES) + f"SELECT conv_id, pos, {snip('content')} AS snippet FROM messages"

SQL["safe_filenames"] = with_(MESSAGES, HEADERS) + f"SELECT conv_id, {safe_sql('title', 'conv_id')} AS file_name FROM headers"

SQL["star_bar"] = with_(*FULL) + f"""
SELECT conv_id, {numtext('relevance_score')} AS relevance, {stars_sql('relevance_score')} AS stars FROM labelled"""

# ---------------------------------------------------------------- labels, responses, discovery, ask, review


def condensed_cte(max_chars: int, name: str = "cond") -> str:
    head, tail = int(max_chars * 0.6), int(max_chars * 0.35)
    cap = "CASE WHEN length(m.content) > 1500 THEN substring(m.content, 1, 1500) || ' [...]' ELSE m.content END"
    return f"""{name}_t AS (
  SELECT h.conv_id, '# ' || h.title || chr(10) || chr(10)
         || string_agg('[' || upper(m.role) || ']: ' || {cap} || chr(10), chr(10) ORDER BY m.pos) AS t
  FROM headers h JOIN messages m ON h.conv_id = m.conv_id GROUP BY h.conv_id, h.title),
{name} AS (
  SELECT conv_id, CASE WHEN length(t) > {max_chars}
                     THEN substring(t, 1, {head}) || chr(10) || chr(10) || '[... middle truncated ...]' || chr(10) || chr(10)
                          || substring(t, length(t) - {tail} + 1, {tail})
                     ELSE t END AS condensed
  FROM {name}_t)"""


DONE = "done AS (SELECT conv_id FROM state WHERE summary <> '' OR len(tags) > 0)"

SQL["label_prompts"] = with_(*FULL, DONE, condensed_cte(8000)) + """
SELECT 'label:' || p.conv_id AS prompt_id, p.conv_id,
       '<transcript>' || chr(10) || c.condensed || chr(10) || '</transcript>' || chr(10) || 'Catalogue entry:' AS prompt
FROM pool p JOIN cond c ON p.conv_id = c.conv_id WHERE p.conv_id NOT IN (SELECT conv_id FROM done)"""

LRESP = """lr AS (
  SELECT s.*, to_json({'categories': CASE WHEN s.conv_id % 13 = 0 THEN list_append(s.categories, 'made-up-slug') ELSE s.categories END,
                       'tags': s.tags, 'summary': s.summary, 'key_facts': s.key_facts, 'relevance_score': CASE WHEN s.conv_id % 19 = 0 THEN '"high"'::JSON ELSE to_json(s.relevance_score) END}) AS body
  FROM state s WHERE s.conv_id IN (SELECT conv_id FROM pool))"""

SQL["parse_label_responses"] = with_(*FULL, LRESP) + """
SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN conv_id % 11 <> 0 THEN array_to_string(categories, '|') END AS categories,
       CASE WHEN conv_id % 11 <> 0 THEN array_to_string(tags[1:10], '|') END AS tags,
       CASE WHEN conv_id % 11 <> 0 THEN summary END AS summary,
       CASE WHEN conv_id % 11 <> 0 THEN array_to_string(key_facts, '|') END AS key_facts,
       CASE WHEN conv_id % 11 <> 0 THEN CASE WHEN conv_id % 19 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, relevance_score)) END END AS relevance_score
FROM lr"""

SQL["strip_and_extract_json"] = with_(*FULL, LRESP) + """
SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN NULL ELSE CAST(body AS VARCHAR) END AS json_text FROM lr"""


def _label_body() -> str:
    b = "CASE WHEN conv_id % 11 = 0 THEN substring(CAST(body AS VARCHAR), 1, 25) ELSE CAST(body AS VARCHAR) END"
    b = f"CASE WHEN conv_id % 3 = 0 THEN '```json' || chr(10) || {b} || chr(10) || '```' ELSE {b} END"
    return f"CASE WHEN conv_id % 7 = 0 THEN '<think>' || chr(10) || 'weighing {{the}} options' || chr(10) || '</think>' || chr(10) || {b} ELSE {b} END"


SQL["response_text"] = with_(*FULL, LRESP) + f"""
SELECT conv_id, {_label_body()} AS text, true AS same_as_trimmed FROM lr"""

SQL["generate_stub"] = with_(*FULL) + """
SELECT 'label:' || conv_id AS prompt_id,
       CASE WHEN conv_id % 10 = 7 THEN NULL ELSE 'ok:label:' || conv_id END AS response,
       CASE WHEN conv_id % 10 = 7 THEN 'ValueError: boom label:' || conv_id END AS error
FROM pool WHERE conv_id IN (SELECT conv_id FROM state)"""

SQL["run_counts"] = with_(*FULL, DONE) + """
, st AS (
  SELECT CASE WHEN p.conv_id IN (SELECT conv_id FROM done) THEN 'skipped'
              WHEN p.conv_id NOT IN (SELECT conv_id FROM state) OR p.conv_id % 11 = 0 THEN 'error'
              ELSE 'retried' END AS status
  FROM pool p)
SELECT status, count(*) AS conversations FROM st GROUP BY status"""

SQL["concat_ordered"] = with_(MESSAGES) + """
SELECT conv_id, chunk, string_agg(content, chr(10) ORDER BY pos) AS text FROM (
  SELECT conv_id, pos, content, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1) // 1000 AS BIGINT) AS chunk
  FROM messages) GROUP BY conv_id, chunk"""

SAMPLE = """ranked AS (SELECT conv_id, title, create_time, row_number() OVER (ORDER BY create_time DESC, conv_id) - 1 AS p FROM pool),
cnt AS (SELECT count(*) AS n FROM ranked),
pos AS (SELECT t.i AS sample_ord, least((2 * t.i * cnt.n + 50) // 100, cnt.n - 1) AS sample_pos FROM range(50) t(i), cnt),
sampled AS (
  SELECT r.conv_id, r.title, r.create_time, pos.sample_ord FROM ranked r JOIN pos ON r.p = pos.sample_pos WHERE (SELECT n FROM cnt) > 50
  UNION ALL SELECT conv_id, title, create_time, p AS sample_ord FROM ranked WHERE (SELECT n FROM cnt) <= 50),
batches AS (SELECT *, CAST(sample_ord // 5 AS BIGINT) AS batch, CAST(sample_ord % 5 AS BIGINT) AS item_pos FROM sampled)"""

def _existing_list() -> str:
    return " || ".join(q(f"{s} = {n}") + " || chr(10)" for s, n, _, _ in CATEGORY_ROWS)


def _explore_sql(known: str) -> str:
    return with_(*FULL, condensed_cte(600, "c600"), SAMPLE) + f"""
SELECT 'explore:' || b.batch AS prompt_id, b.batch,
       {known} || string_agg('<conversation title="' || b.title || '" started="' || {fmt_sql('b.create_time')} || '">' || chr(10) || c.condensed,
                     chr(10) || chr(10) ORDER BY b.sample_ord) AS prompt
FROM batches b JOIN c600 c ON b.conv_id = c.conv_id GROUP BY b.batch"""


SQL["explore_prompts"] = _explore_sql(f"'Shelves so far:' || chr(10) || {_existing_list()} || chr(10)")
SQL["explore_free"] = _explore_sql("''")

SUGG = """sugg AS (
  SELECT batch, item_pos, 'topic-' || (conv_id % 9) AS slug,
         CASE WHEN conv_id % 9 <> 4 THEN 'Topic ' || (conv_id % 9) END AS name,
         repeat('d', CAST(conv_id % 17 AS INTEGER)) AS description, [title] AS sample_titles
  FROM batches WHERE batch <> 3),
allsug AS (
  SELECT 'topic-1' AS slug, 'Seeded topic one' AS name, 'seed' AS description, ['Seed title'] AS sample_titles,
         CAST(3 AS BIGINT) AS n, 0 AS src, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS p
  UNION ALL SELECT slug, name, description, sample_titles, 1, 1, batch, item_pos FROM sugg),
ranked_s AS (
  SELECT *, row_number() OVER (PARTITION BY slug ORDER BY src, b, p) AS first_rn,
            row_number() OVER (PARTITION BY slug ORDER BY length(coalesce(description, '')) DESC, src, b, p) AS desc_rn
  FROM allsug),
merged AS (
  SELECT slug,
         max(coalesce(name, slug)) FILTER (WHERE first_rn = 1) AS name,
         max(coalesce(description, '')) FILTER (WHERE desc_rn = 1) AS description,
         flatten(list(sample_titles ORDER BY src, b, p)) AS all_titles,
         CAST(sum(n) AS BIGINT) AS count
  FROM ranked_s GROUP BY slug)"""

DISC = (*FULL, SAMPLE, SUGG)

SQL["new_suggestions"] = with_(*DISC) + """
SELECT batch, item_pos, slug, name, description, array_to_string(sample_titles, '|') AS sample_titles FROM sugg"""

SQL["suggestion_merge"] = with_(*DISC) + f"""
SELECT slug, name, description, array_to_string({odistinct('all_titles')}, '|') AS sample_titles, count FROM merged"""

STOP = "['and', 'the', 'of', 'in', 'for', 'a', 'an', 'to', 'with', '&', '/']"


def kw_sql(name: str, slug: str) -> str:
    nw = f"list_filter(regexp_split_to_array(lower(coalesce({name}, '')), '[\\s\\-_]+'), lambda w: NOT list_contains({STOP}, w) AND length(w) > 2)"
    sw = f"list_filter(string_split(coalesce({slug}, ''), '-'), lambda w: length(w) > 2)"
    return odistinct(f"list_concat({nw}, {sw})")


SQL["generate_keywords"] = with_(*DISC) + f"""
SELECT slug, array_to_string({kw_sql('name', 'slug')}, '|') AS keywords FROM merged"""

SQL["discovery_top"] = with_(*DISC) + f"""
SELECT slug, name, count, array_to_string(({odistinct('all_titles')})[1:3], '|') AS head_titles FROM merged"""

SQL["apply_discovery"] = with_(*DISC) + f"""
, dec AS (
  SELECT slug, name, description, {kw_sql('name', 'slug')} AS kw,
         TRY_CAST(regexp_extract(slug, '(\\d+)$', 1) AS INTEGER) AS n FROM merged),
cat2 AS (
  SELECT slug, name, description, keywords FROM cats WHERE slug NOT IN (SELECT slug FROM dec WHERE n IN (0, 3, 6))
  UNION ALL SELECT slug, name, coalesce(description, ''), kw FROM dec WHERE n IN (0, 3, 6)),
mg AS (
  SELECT CASE n WHEN 1 THEN 'english' WHEN 2 THEN 'topic-0' ELSE 'nowhere' END AS target,
         flatten(list(kw ORDER BY n)) AS extra
  FROM dec WHERE n IN (1, 2, 4) GROUP BY 1)
SELECT c.slug, c.name, c.description,
       array_to_string(CASE WHEN mg.extra IS NULL THEN c.keywords ELSE {odistinct('list_concat(c.keywords, mg.extra)')} END, '|') AS keywords
FROM cat2 c LEFT JOIN mg ON c.slug = mg.target"""

ASKPOOL = """ap AS (
  SELECT *, row_number() OVER (ORDER BY relevance_score DESC, create_time DESC, conv_id) AS pool_rank
  FROM labelled WHERE relevance_score >= 0.3)"""

TRANS = f"""mb AS (
  SELECT conv_id, pos,
         {lines_sql("[CASE WHEN role = 'user' THEN '### 🧑 User' ELSE '### 🤖 Assistant' END]",
                    when_list("ts > 0", "['_' || " + fmt_sql('ts', LONG) + " || '_']"),
                    "['', content, '', '---', '']")} AS block
  FROM messages),
tr AS (
  SELECT h.conv_id, '# ' || h.title || chr(10) || chr(10) || '_Created: ' || {fmt_sql('h.create_time', LONG)} || '_' || chr(10) || chr(10)
         || '---' || chr(10) || chr(10) || string_agg(mb.block, chr(10) ORDER BY mb.pos) AS markdown
  FROM headers h JOIN mb ON h.conv_id = mb.conv_id GROUP BY h.conv_id, h.title, h.create_time)"""

SQL["ask_pool_state"] = with_(*FULL, ASKPOOL) + "SELECT conv_id, relevance_score, pool_rank FROM ap"

SQL["ask_pool_raw"] = with_(MESSAGES, HEADERS, POOL) + """
SELECT conv_id, row_number() OVER (ORDER BY create_time DESC, conv_id) AS pool_rank FROM pool"""

ASKP = """askp AS (
  SELECT CAST((ap.pool_rank - 1) // 3 AS BIGINT) AS batch,
         string_agg(tr.markdown, chr(10) ORDER BY ap.pool_rank) || chr(10) || 'Request: What was decided?' AS prompt
  FROM ap JOIN tr ON ap.conv_id = tr.conv_id GROUP BY 1)"""

SQL["ask_prompts"] = with_(*FULL, ASKPOOL, TRANS, ASKP) + "SELECT 'ask:' || batch AS prompt_id, batch, prompt FROM askp"

SQL["synthesis_prompts"] = with_(*FULL, ASKPOOL, TRANS, ASKP) + """
SELECT 'synth1:0' AS prompt_id, count(*) AS n_answers,
       string_agg('<draft ' || (batch + 1) || '>' || chr(10) || 'Partial answer from batch ' || batch || '.' || chr(10) || '</draft>' || chr(10), '' ORDER BY batch)
       || chr(10) || 'Request: What was decided?' AS prompt
FROM askp"""

SQL["answer_document"] = with_(*FULL, ASKPOOL, TRANS, ASKP) + f"""
, nb AS (SELECT count(*) AS n FROM askp)
SELECT 0 AS part, CAST(0 AS BIGINT) AS pool_rank,
       '# Ask: What was decided?' || chr(10) || chr(10) || '_Generated: 01 Jun 2024 00:00_' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
       || CASE WHEN n = 1 THEN 'Partial answer from batch 0.' ELSE 'Combined answer over ' || n || ' partial answers.' END
       || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Sources' || chr(10) AS block
FROM nb
UNION ALL
SELECT 1 AS part, pool_rank, '- **' || title || '** (' || {fmt_sql('create_time')} || ')' AS block FROM ap"""

SQL["ask_sources"] = with_(*FULL, ASKPOOL) + f"SELECT pool_rank, conv_id, title, {fmt_sql('create_time')} AS created FROM ap"

SQL["stub_conversations"] = with_(*BASE, STATE) + """
, txt AS (
  SELECT conv_id, title, created,
         CASE WHEN summary <> '' THEN '**Summary:** ' || summary || chr(10) || chr(10) ELSE '' END
         || CASE WHEN len(key_facts) > 0 THEN '**Key facts:**' || chr(10) || array_to_string(list_transform(key_facts, lambda f: '- ' || f || chr(10)), '') || chr(10) ELSE '' END
         || CASE WHEN len(tags) > 0 THEN '**Tags:** ' || array_to_string(tags, ', ') || chr(10) ELSE '' END AS t
  FROM state)
SELECT conv_id, title, CAST(epoch(strptime(created, '%Y-%m-%d %H:%M')) AS DOUBLE) AS create_time,
       CASE WHEN t <> '' THEN t ELSE '(no summary available)' END AS content
FROM txt"""

SQL["enhanced_hydrate"] = with_(*ENH, FLAGS, SLICES, EXPAND) + """
, rl AS (SELECT conv_id, string_agg((CAST(split_part(range_key, '-', 1) AS INTEGER) + 1) || '–'
                                    || (CAST(split_part(range_key, '-', 2) AS INTEGER) + 1), '|' ORDER BY entry_pos) AS range_labels
         FROM exo GROUP BY conv_id)
SELECT l.conv_id, l.summary AS digest_summary, array_to_string(l.key_facts, '|') AS digest_facts,
       l.conv_id IN (SELECT conv_id FROM ol) AS has_enhanced, coalesce(rl.range_labels, '') AS range_labels
FROM labelled l LEFT JOIN rl ON l.conv_id = rl.conv_id"""

SQL["apply_review_edits"] = with_(*BASE, STATE) + """
SELECT conv_id,
       CASE conv_id % 6 WHEN 1 THEN 'german' WHEN 4 THEN 'spanish|english' ELSE array_to_string(categories, '|') END AS categories,
       CASE conv_id % 6 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 WHEN 4 THEN 0.0 ELSE relevance_score END AS relevance_score
FROM state"""

# ---------------------------------------------------------------- ingest
SQL["linearise_tree"] = """
WITH RECURSIVE nodes AS (
  SELECT conv_id, turn, CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 2 THEN turn - 2 ELSE turn - 1 END AS parent
  FROM conversations),
walk(conv_id, turn, path) AS (
  SELECT conv_id, turn, [turn] FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT n.conv_id, n.turn, list_append(w.path, n.turn) FROM nodes n JOIN walk w ON n.conv_id = w.conv_id AND n.parent = w.turn)
SELECT conv_id, CAST(turn AS VARCHAR) AS node_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS BIGINT) AS pos
FROM walk"""

INGESTED = f"""ing AS (
  SELECT CAST(h.conv_id AS VARCHAR) AS conv_id,
         CASE WHEN h.conv_id % 10 = 0 THEN h.title || ' (revised)' ELSE h.title END AS title,
         'export-' || CASE WHEN h.conv_id % 10 = 0 THEN 2 ELSE h.conv_id % 3 END || '-' || lpad(CAST(h.conv_id // {3 * FILE_CONVERSATIONS} AS VARCHAR), 8, '0') || '.json' AS file,
         h.create_time, h.update_time, h.message_count, h.user_messages
  FROM headers h)"""

SQL["ingest_roundtrip"] = with_(MESSAGES, HEADERS, INGESTED) + """
SELECT i.conv_id, CAST(row_number() OVER (PARTITION BY m.conv_id ORDER BY m.pos) - 1 AS BIGINT) AS pos,
       m.role, m.content, m.ts, i.title
FROM messages m JOIN ing i ON CAST(m.conv_id AS VARCHAR) = i.conv_id"""

SQL["dedup_last_wins"] = with_(MESSAGES, HEADERS, INGESTED) + "SELECT * FROM ing"

SQL["content_text"] = f"""
SELECT conv_id, turn,
       CASE (conv_id + turn) % 5
         WHEN 0 THEN trim(text, {TRIM})
         WHEN 1 THEN trim(text || chr(10) || '  tail  ', {TRIM})
         WHEN 2 THEN trim(text || chr(10) || 'caption' || chr(10) || '', {TRIM})
         WHEN 3 THEN ''
         ELSE trim(text, {TRIM}) END AS text
FROM conversations"""

# ---------------------------------------------------------------- stored tables and streaming
SQL["category_table_load"] = SQL["apply_discovery"]
SQL["state_upsert"] = SQL["apply_review_edits"]
SQL["index_roundtrip"] = SQL["index_upsert"]
SQL["discovery_roundtrip"] = SQL["suggestion_merge"]

SQL["categories_upsert"] = with_(*DISC) + """
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS BIGINT) AS cat_ord, slug, name FROM (
  SELECT cat_ord AS o, slug, name FROM cats
  UNION ALL
  SELECT 1000000 + CAST(regexp_extract(slug, '(\\d+)$', 1) AS INTEGER), slug, coalesce(name, slug) FROM merged
  WHERE TRY_CAST(regexp_extract(slug, '(\\d+)$', 1) AS INTEGER) IN (0, 3, 6))"""

SQL["state_clear"] = with_(*ENH) + """
SELECT DISTINCT conv_id FROM ol WHERE conv_id NOT IN (SELECT conv_id FROM labelled WHERE list_contains(categories, 'german'))"""

SQL["enhanced_upsert"] = with_(*ENH) + "SELECT conv_id, count(*) AS n_summaries FROM ol GROUP BY conv_id"

SQL["category_index_merge"] = SQL["category_index"] + """
UNION ALL SELECT 'legacy', 'Legacy', CAST(3 AS BIGINT), 0.4::DOUBLE"""

SQL["incremental_ingest"] = with_(MESSAGES, HEADERS, INGESTED) + f"""
SELECT conv_id AS id, title, {fmt_sql('create_time')} AS created, {fmt_sql('update_time')} AS updated,
       message_count AS messages, user_messages FROM ing WHERE message_count >= 4"""

SQL["label_stream"] = with_(*BASE, STATE, POOL) + """
SELECT conv_id, array_to_string(categories, '|') AS categories, summary, relevance_score FROM state
UNION ALL
SELECT p.conv_id, array_to_string(k.categories, '|') AS categories, '' AS summary, 0.5::DOUBLE AS relevance_score
FROM pool p JOIN kwlabels k ON p.conv_id = k.conv_id WHERE p.conv_id NOT IN (SELECT conv_id FROM state)"""

SQL["index_by_created"] = "WITH upserted AS (" + SQL["index_upsert"].replace("WITH ", "WITH ", 1) + """)
SELECT row_number() OVER (ORDER BY created DESC, id) AS position, id, created, title FROM upserted"""

SQL["ask_pool_ids"] = with_(MESSAGES, HEADERS, POOL, IDS) + """
SELECT p.conv_id, p.title, row_number() OVER (ORDER BY ids.opt_ord, ids.part_ord) AS pool_rank
FROM ids JOIN pool p ON ids.conv_id = p.conv_id"""

SQL["answer_levels"] = with_(*FULL, ASKPOOL, TRANS, ASKP).replace("WITH ", "WITH RECURSIVE ", 1) + """
, lv AS (SELECT count(*) AS k, count(*) AS n FROM askp UNION ALL SELECT (k + 2) // 3, n FROM lv WHERE k > 3)
SELECT CASE WHEN n = 1 THEN 'Partial answer from batch 0.' ELSE 'Combined answer over ' || min(k) || ' partial answers.' END AS answer, n AS batch_count
FROM lv GROUP BY n"""

SQL["ask_prompts_ids"] = with_(MESSAGES, HEADERS, POOL, IDS, TRANS) + """
, ranked AS (SELECT p.conv_id, row_number() OVER (ORDER BY ids.opt_ord, ids.part_ord) AS pool_rank FROM ids JOIN pool p ON ids.conv_id = p.conv_id)
SELECT 'ask:' || ((pool_rank - 1) // 3) AS prompt_id, CAST((pool_rank - 1) // 3 AS BIGINT) AS batch,
       string_agg(tr.markdown, chr(10) ORDER BY pool_rank) || chr(10) || 'Request: What was decided?' AS prompt
FROM ranked JOIN tr ON ranked.conv_id = tr.conv_id GROUP BY (pool_rank - 1) // 3"""

SQL["ask_pool_stub"] = with_(*BASE, STATE) + """
SELECT conv_id, title, relevance_score, row_number() OVER (ORDER BY relevance_score DESC, created DESC, conv_id) AS pool_rank
FROM state WHERE len(categories) > 0 AND relevance_score >= 0.3"""

SQL["ask_failed_batch"] = with_(*FULL, ASKPOOL, TRANS, ASKP) + "SELECT batch, 'RuntimeError: timeout' AS error FROM askp WHERE batch % 5 = 2"

SQL["answer_file"] = "WITH doc AS (" + SQL["answer_document"] + ") SELECT unnest(string_split(block, chr(10))) AS line FROM doc"

SQL["category_json_files"] = "SELECT * EXCLUDE (conv_id) FROM (" + SQL["category_json"] + ")"

SQL["concat_chunked"] = SQL["concat_ordered"].replace("// 1000", "// 3")

SQL["label_many_categories"] = """
WITH cats AS (SELECT DISTINCT 'order-' || l_orderkey AS slug FROM lineitem),
named AS (
  SELECT o_orderkey, unnest([1, 2, 3, 4]) AS pos,
         unnest(['order-' || (o_orderkey + 1), 'nope-' || o_orderkey, 'order-' || o_orderkey, 'order-' || (o_orderkey + 7)]) AS slug FROM orders)
SELECT o_orderkey, coalesce(string_agg(n.slug, '|' ORDER BY pos) FILTER (WHERE c.slug IS NOT NULL), '') AS categories
FROM named n LEFT JOIN cats c ON n.slug = c.slug GROUP BY o_orderkey"""

SQL["ingest_flat"] = with_(MESSAGES, HEADERS) + """
SELECT CAST(m.conv_id AS VARCHAR) AS conv_id, CAST(row_number() OVER (PARTITION BY m.conv_id ORDER BY m.pos) - 1 AS BIGINT) AS pos,
       m.role, m.content, m.ts, h.title, h.message_count
FROM messages m JOIN headers h ON m.conv_id = h.conv_id"""

SQL["ingest_split"] = SQL["ingest_roundtrip"]

SQL["linearise_dag"] = """
WITH RECURSIVE nodes AS (
  SELECT conv_id, turn, CASE WHEN turn = 0 THEN NULL WHEN turn = 3 AND conv_id % 2 = 0 THEN 0 WHEN turn % 3 = 2 THEN turn - 2 ELSE turn - 1 END AS parent,
         CASE WHEN turn = 3 AND conv_id % 2 = 0 THEN -1 ELSE turn END AS ord
  FROM conversations),
walk(conv_id, turn, path) AS (
  SELECT conv_id, turn, [ord] FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT n.conv_id, n.turn, list_append(w.path, n.ord) FROM nodes n JOIN walk w ON n.conv_id = w.conv_id AND n.parent = w.turn)
SELECT conv_id, CAST(turn AS VARCHAR) AS node_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS BIGINT) AS pos
FROM walk"""

SQL["keyword_label_many"] = with_(MESSAGES, HEADERS, """words AS (
  SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM documents),
cats AS (SELECT 0 AS cat_ord, substr(word, 1, 3) AS slug, list(word) AS keywords FROM words WHERE word <> '' GROUP BY slug)""",
    KEYWORD.replace("list(slug ORDER BY cat_ord)", "list(slug ORDER BY slug)")) + """
SELECT conv_id, array_to_string(categories, '|') AS categories, CAST(0.5 AS DOUBLE) AS relevance_score FROM kwlabels"""

SQL["stream_then_stats"] = with_(MESSAGES, HEADERS) + f"""
SELECT count(*) AS raw, count(*) FILTER (WHERE message_count >= 4) AS filtered, CAST(0 AS BIGINT) AS labelled,
       count(*) FILTER (WHERE message_count >= 4) AS unlabelled,
       CAST(coalesce(sum(message_count) FILTER (WHERE message_count >= 4), 0) AS BIGINT) AS total_messages,
       CAST({dround('CAST(coalesce(sum(message_count) FILTER (WHERE message_count >= 4), 0) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE message_count >= 4))', 0)} AS BIGINT) AS avg_messages
FROM headers"""

SQL["label_stream_model"] = with_(*BASE, STATE, POOL) + """
SELECT conv_id, array_to_string(categories, '|') AS categories, summary,
       CASE WHEN conv_id % 5 = 0 AND conv_id % 19 = 0 AND conv_id % 11 <> 0 AND conv_id IN (SELECT conv_id FROM pool) THEN 0.0 ELSE relevance_score END AS relevance_score
FROM state"""
