"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.ann import op3_ann
from millrace.llm.bpe import op6_bpe
from millrace.llm.bytepair import op13_bytepair
from millrace.llm.html import op5_html
from millrace.llm.importance import op12_resample
from millrace.llm.language import op4_language
from millrace.llm.minhash import op7_minhash
from millrace.llm.neardup import op1_neardup
from millrace.llm.overlap import op11_overlap
from millrace.llm.packing import op2_packing
from millrace.llm.pii import op10_pii
from millrace.llm.quality import op9_quality
from millrace.llm.sharding import op8_sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neardup": op1_neardup,
    "op2_packing": op2_packing,
    "op3_ann": op3_ann,
    "op4_language": op4_language,
    "op5_html": op5_html,
    "op6_bpe": op6_bpe,
    "op7_minhash": op7_minhash,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
    "op11_overlap": op11_overlap,
    "op12_resample": op12_resample,
    "op13_bytepair": op13_bytepair,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A table for crc32 by bytes, from the standard's polynomial, and the crc32 of a text's UTF-8 bytes over it; DuckDB has no such function.
_CRC_TABLE = """crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""


def _crc(text: str) -> str:
    of_bytes = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {of_bytes}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


#: The other queries sample, learn, hash or tokenize; tests hold them against brute force, held-out labels or the library.
ORACLES: dict[str, str] = {
    "op1_neardup": """WITH RECURSIVE good AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  half AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
  links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
  reach(id, met) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.met = links.a),
  comp AS (SELECT id, min(met) AS c FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
  SELECT vec_id, coalesce(n.n, 0) AS n_links, comp.c AS component_id, vec_id = comp.c AS kept FROM embeddings JOIN comp ON id = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op7_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w) x UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1) y),
  n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
  sized AS (SELECT s.doc_id, g, n FROM s JOIN n ON n.doc_id = s.doc_id),
  half AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sized a JOIN sized b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
  reach(id, met) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.met = links.a),
  comp AS (SELECT id, min(met) AS c FROM reach GROUP BY id)
  SELECT n.doc_id, n.n AS n_shingles, comp.c AS component_id, n.doc_id = comp.c AS kept FROM n JOIN comp ON comp.id = n.doc_id""",
    "op11_overlap": f"""WITH {_CRC_TABLE},
  times AS (SELECT client_id, epoch_us(ts) AS t, bool_or(coalesce(kind = 'click', FALSE)) AS hit FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY client_id, ts),
  begun AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY client_id ORDER BY t) <= 300000000 THEN 0 ELSE 1 END AS b FROM times),
  numbered AS (SELECT *, sum(b) OVER (PARTITION BY client_id ORDER BY t) AS n FROM begun),
  found AS (SELECT client_id, min(t) AS first, max(t) AS last, arg_max(hit, t) AS open FROM numbered GROUP BY client_id, n),
  sess AS (SELECT client_id, first // 86400000000 AS a, CASE WHEN open THEN NULL ELSE last // 86400000000 END AS b,
    {_crc('first::VARCHAR')} AS crc FROM found, crc_table),
  ends AS (SELECT sale_id, max(shipped_at) AS shipped_at FROM sale_lines GROUP BY sale_id),
  sold AS (SELECT s.sale_id, client_id, epoch_us(sold_at) // 86400000000 AS s, CASE WHEN status = 'held' THEN NULL ELSE epoch_us(greatest(sold_at, shipped_at)) // 86400000000 END AS e
    FROM sales s LEFT JOIN ends ON ends.sale_id = s.sale_id WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
  pairs AS (SELECT sale_id, [['overlaps', 'finished_by', 'contains'], ['starts', 'equals', 'started_by'], ['during', 'finishes', 'overlapped_by']][CASE WHEN s < a THEN 1 WHEN s = a THEN 2 ELSE 3 END][
      CASE WHEN coalesce(e, 9000000000) < coalesce(b, 9000000000) THEN 1 WHEN coalesce(e, 9000000000) = coalesce(b, 9000000000) THEN 2 ELSE 3 END] AS relation,
    CASE WHEN b IS NOT NULL OR e IS NOT NULL THEN least(coalesce(e, b), coalesce(b, e)) - greatest(s, a) + 1 END AS shared, crc
    FROM sold JOIN sess ON sold.client_id = sess.client_id AND s <= coalesce(b, 9000000000) AND a <= coalesce(e, 9000000000))
SELECT sale_id, relation, count(*) AS n_pairs, sum(shared)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc FROM pairs GROUP BY sale_id, relation""",
    "op12_resample": f"""WITH {_CRC_TABLE},
  texts AS (SELECT TRUE AS own, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT FALSE, row_number() OVER (), NULL, text FROM benchmark),
  words AS (SELECT own, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
  grams AS (SELECT own, r, array_to_string(w[i:i + k], ' ') AS g FROM (SELECT own, r, w, unnest(range(1, len(w) + 1)) AS i FROM words) x, range(3) k(k) WHERE i + k <= len(w)),
  hashed AS (SELECT g, {_crc('g')} % 10000 AS b FROM (SELECT DISTINCT g FROM grams) x, crc_table),
  used AS (SELECT own, r, b, count(*) AS n FROM grams JOIN hashed USING (g) GROUP BY own, r, b),
  counts AS (SELECT b, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM used GROUP BY b),
  totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
  gains AS (SELECT b, floor(1000 * ln((t::DOUBLE + 1) * (s_all::DOUBLE + 10000) / ((s::DOUBLE + 1) * (t_all::DOUBLE + 10000))))::BIGINT AS gain FROM counts, totals),
  weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM used JOIN gains USING (b) WHERE own GROUP BY r),
  scored AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM (SELECT * FROM words WHERE own) x LEFT JOIN weights USING (r)),
  able AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20 AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN able USING (r)""",
}
