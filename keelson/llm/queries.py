"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op12_bpe_round_trip
from .chat import OP3_SQL, op3_chat_format
from .decontam import op9_decontaminate
from .katz import op8_katz_scores
from .langid import op4_language_id
from .mixing import op7_source_mix
from .quality import op1_divergence_rules
from .ranking import OP13_SQL, op13_ranked_search
from .repair import op11_conversation_repair
from .simhash import op2_simhash_near_dedup
from .substring import op5_substring_dedup
from .tokencount import op10_token_counts
from .urllm import op6_url_filter

QUERIES = {f.__name__: f for f in (op1_divergence_rules, op2_simhash_near_dedup, op3_chat_format, op4_language_id, op5_substring_dedup, op6_url_filter, op7_source_mix, op8_katz_scores, op9_decontaminate, op10_token_counts, op11_conversation_repair, op12_bpe_round_trip, op13_ranked_search)}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')"

ORACLES = {
    "op3_chat_format": OP3_SQL,
    "op13_ranked_search": OP13_SQL,
    "op5_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM rep),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
tally AS (SELECT word.doc_id, count(*) AS n_words, count(gone.p) AS n_removed,
                 string_agg(x, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS kept
          FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, cast(coalesce(n_words, 0) AS BIGINT) AS n_words, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN tally ON d.doc_id = tally.doc_id""",
}
