"""Queries of this subpackage, and their SQL where SQL can express them.

Of operators that SQL expresses in part, a query of its own (secret_counts, license_places, mixture_targets) has the columns that it can.
"""

from __future__ import annotations

from readloom.llm.chat import ROTATION_SQL, op7_chat_rotation
from readloom.llm.decontaminate import op9_decontaminate
from readloom.llm.licenses import op5_license_scan
from readloom.llm.lm import op10_lm_score
from readloom.llm.media import media_pages, op6_media_columns
from readloom.llm.mixing import op8_mixture
from readloom.llm.secrets import op3_secret_scan
from readloom.llm.simhash import op2_simhash_dedup
from readloom.llm.tokens import op4_token_binary
from readloom.llm.toxicity import op1_toxicity


def secret_counts(spark, sf_dir: str):
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def license_places(spark, sf_dir: str):
    return op5_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def mixture_targets(spark, sf_dir: str):
    return op8_mixture(spark, sf_dir).select("doc_id", "size", "source_size", "target")


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_simhash_dedup, op3_secret_scan, op4_token_binary, op5_license_scan, op6_media_columns, op7_chat_rotation, op8_mixture, op9_decontaminate, op10_lm_score,
        media_pages, secret_counts, license_places, mixture_targets,
    )
}

SECRETS_SQL = r"""select doc_id,
  len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) as n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) as n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) as n_hex
from (select doc_id, coalesce(text, '') as t from documents)"""

LICENSES_SQL = r"""with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' and w[i + 1] = 'by') as cc,
  list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' and w[i + 1] = 'public' and w[i + 2] = 'license') as gpl,
  list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' and w[i + 1] = 'rights' and w[i + 2] = 'reserved') as res from w)
select doc_id, len(w) as n_words, len(cc) + len(gpl) + len(res) as n_base, cast(list_min(cc || gpl || res) - 1 as bigint) as first_word, cast(list_max(cc || gpl || res) - 1 as bigint) as last_word,
  concat_ws(',', case when len(cc) > 0 then 'cc-by' end, case when len(gpl) > 0 then 'gpl' end, case when len(res) > 0 then 'reserved' end) as base_labels from p"""

MIXTURE_SQL = r"""with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as total, (row_number() over (order by source is null, source) - 1) % 3 + 1 as weight from d group by source),
o as (select *, row_number() over (order by total / weight, source) as k from s),
c as (select *, (select sum(total) from s) - 3 * coalesce(sum(total) over (order by k rows between unbounded preceding and 1 preceding), 0) as rest,
  sum(weight) over (order by k rows between current row and unbounded following) as left_weight from o),
p as (select cast(rest as double) / cast(left_weight as double) as per from c where weight * (cast(rest as double) / cast(left_weight as double)) <= 3 * total order by k limit 1)
select doc_id, size, total as source_size, case when weight * per > 3 * total then cast(3 * total as double) else weight * per end as target
from d join s on d.source is not distinct from s.source, p"""

ORACLE_SQL = {"op7_chat_rotation": ROTATION_SQL, "secret_counts": SECRETS_SQL, "license_places": LICENSES_SQL, "mixture_targets": MIXTURE_SQL}
