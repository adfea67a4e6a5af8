"""The same questions in plain SQL, for the operators that SQL can express."""

from __future__ import annotations

from .chat import BEGINS, CLOSE, OPEN, SEGMENT_TURNS
from .line_dedup import HIDDEN, HOST, LEAST_PAGES, RATIO, TAG
from .mixing import BINS, BUDGET, MOST_EPOCHS, SEED, WEIGHTS

LINES = f"""
WITH texts AS (
  SELECT page_id, coalesce(regexp_extract(url, '{HOST}', 1), '') AS host,
    regexp_replace(regexp_replace(html, '{HIDDEN}', ' ', 'g'), '{TAG}', chr(10), 'g') AS text
  FROM pages
), lines AS (
  SELECT page_id, host, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS place
  FROM texts
), totals AS (SELECT host, count(*) AS total FROM texts GROUP BY host),
frequent AS (
  SELECT host, trim(line) AS line, count(DISTINCT page_id) AS pages
  FROM lines WHERE trim(line) <> '' GROUP BY ALL
), dropped AS (
  SELECT host, line FROM frequent JOIN totals USING (host)
  WHERE pages >= {LEAST_PAGES} AND pages > {RATIO} * total
), kept AS (
  SELECT page_id, string_agg(l.line, chr(10) ORDER BY place) AS text
  FROM lines l LEFT JOIN dropped d ON l.host = d.host AND trim(l.line) = d.line
  WHERE d.line IS NULL GROUP BY page_id
)
SELECT t.page_id, t.host, CASE WHEN t.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM texts t LEFT JOIN kept k USING (page_id)
"""


def _unmarked(column: str) -> str:
    return rf"regexp_replace(coalesce({column}, ''), '{BEGINS}', '<\\\1|', 'g')"


CHAT = f"""
WITH placed AS (
  SELECT *, row_number() OVER o AS place, lead(turn) OVER o IS NULL AS last
  FROM conversations
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), prefixed AS (
  SELECT *, string_agg(length(coalesce(role, '')) || ':' || coalesce(role, '') || length(coalesce(text, '')) || ':'
      || coalesce(text, ''), '') OVER (PARTITION BY conv_id ORDER BY place) AS said
  FROM placed
), whole AS (SELECT min(conv_id) AS conv_id, said FROM prefixed WHERE last GROUP BY said),
kept AS (SELECT conv_id FROM whole WHERE said NOT IN (SELECT said FROM prefixed WHERE NOT last))
SELECT conv_id, (place - 1) // {SEGMENT_TURNS} AS segment, count(*) AS n_turns,
  string_agg('{OPEN}' || {_unmarked("role")} || chr(10) || {_unmarked("text")} || '{CLOSE}' || chr(10), '' ORDER BY place) AS text
FROM placed JOIN kept USING (conv_id)
GROUP BY conv_id, (place - 1) // {SEGMENT_TURNS}
"""


def _seeded(purpose: str) -> str:
    return f"('0x' || substr(md5('{SEED}/{purpose}/' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT"


MIXING = f"""
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')), 0)::BIGINT AS size,
    {_seeded("order")} // {2**32 // BINS} AS bin, {_seeded("round")} AS round
  FROM documents
), sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (
  SELECT *, {list(map(float, WEIGHTS))}[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight,
    (sum(source_size) OVER ())::DOUBLE * {BUDGET} AS total, (source_size * {MOST_EPOCHS})::DOUBLE AS cap
  FROM sources
), filling AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM placed
), marked AS (SELECT *, (total - spent) * weight > cap * open AS clamped FROM filling),
aims AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap ELSE weight
    * (total - coalesce(sum(CASE WHEN clamped THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT clamped THEN weight END) OVER () END AS target
  FROM marked
), whole AS (
  SELECT *, target - whole * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM aims)
), bins AS (SELECT source, bin, sum(size)::BIGINT AS words FROM sized GROUP BY source, bin),
filled AS (
  SELECT source, bin, words, sum(words) OVER (PARTITION BY source ORDER BY bin)::BIGINT AS upto FROM bins
), borders AS (
  SELECT w.source, min(bin) AS cut, arg_min((rest - (upto - words)) / words, bin) AS share
  FROM filled f JOIN whole w ON f.source IS NOT DISTINCT FROM w.source WHERE upto > rest GROUP BY w.source
)
SELECT doc_id, size, source_size, target, (size * whole + CASE WHEN bin < coalesce(cut, {BINS}) THEN size
    WHEN bin = cut THEN least(size, floor(size * share + round / 4294967296.0::DOUBLE)) ELSE 0 END)::BIGINT AS taken
FROM sized s JOIN whole w ON s.source IS NOT DISTINCT FROM w.source
LEFT JOIN borders b ON s.source IS NOT DISTINCT FROM b.source
"""

SEARCH = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
