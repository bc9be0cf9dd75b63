"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tilewright.llm.bpe import op8_bpe
from tilewright.llm.crf import op1_toxicity
from tilewright.llm.fingerprint import FINGERPRINT_SQL, fingerprint_base, op2_fingerprint
from tilewright.llm.jaccard import op3_jaccard, op3_links
from tilewright.llm.license import LICENSE_SQL, license_base, op4_license
from tilewright.llm.media import MEDIA_SQL, media_base, op9_media
from tilewright.llm.merkle import OP12_SQL, op12_manifest
from tilewright.llm.mixture import OP5_SQL, op5_mixture
from tilewright.llm.phrases import OP11_SQL, op11_decontamination
from tilewright.llm.quality import op6_quality
from tilewright.llm.chat import op7_chat
from tilewright.llm.spelling import OP13_SQL, op13_spelling
from tilewright.llm.warc import OP10_SQL, op10_warc

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM s
  UNION
  SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
), low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
cls AS (SELECT doc_id, CASE WHEN len(sh) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(sh)) END AS class_id FROM s)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, class_id, component_id FROM s JOIN low ON low.x = s.doc_id JOIN cls USING (doc_id)
"""

# the links of OP3_SQL, counted for each document
OP3_LINKS_SQL = f"""{OP3_SQL[: OP3_SQL.index("reach AS (")]}n AS (SELECT x, count(*) AS n FROM both_ways GROUP BY x)
SELECT r.doc_id, n_shingles, class_id, component_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links FROM ({OP3_SQL}) r LEFT JOIN n ON n.x = r.doc_id"""

QUERIES = {"op1_toxicity": op1_toxicity, "op2_fingerprint": op2_fingerprint, "op3_jaccard": op3_jaccard, "op3_links": op3_links, "op4_license": op4_license, "op5_mixture": op5_mixture, "op6_quality": op6_quality, "op7_chat": op7_chat, "op8_bpe": op8_bpe, "op9_media": op9_media, "op10_warc": op10_warc, "op11_decontamination": op11_decontamination, "op12_manifest": op12_manifest, "op13_spelling": op13_spelling, "fingerprint_base": fingerprint_base, "license_base": license_base, "media_base": media_base}
SQL = {"op3_jaccard": OP3_SQL, "op3_links": OP3_LINKS_SQL, "op5_mixture": OP5_SQL, "op10_warc": OP10_SQL, "op11_decontamination": OP11_SQL, "op12_manifest": OP12_SQL, "op13_spelling": OP13_SQL, "fingerprint_base": FINGERPRINT_SQL, "license_base": LICENSE_SQL, "media_base": MEDIA_SQL}
