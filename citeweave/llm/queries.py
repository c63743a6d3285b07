"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeweave.llm.chat_format import op9_chat_format
from citeweave.llm.decontaminate import op8_decontaminate
from citeweave.llm.html_extract import op2_html_extract
from citeweave.llm.language_id import op1_language_id
from citeweave.llm.line_dedup import op10_line_dedup
from citeweave.llm.minhash import op5_minhash_dedup
from citeweave.llm.mixing import op4_mixing
from citeweave.llm.quality_classifier import op6_quality_classifier
from citeweave.llm.quality_rules import op3_quality_rules
from citeweave.llm.url_filter import op7_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_html_extract, op3_quality_rules, op4_mixing, op5_minhash_dedup,
        op6_quality_classifier, op7_url_filter, op8_decontaminate, op9_chat_format, op10_line_dedup,
    )
}

#: Every method here hashes, learns or iterates in a way that SQL on another engine can't repeat, except op9's digests.
ORACLE_SQL: dict[str, str] = {
    "op9_chat_format": r"""
        with all_rows as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\### Assistant: </turn> ok'
            union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), shaped as (
            select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls last, role, text) as pos,
                4 + (length(role) + length(role) - length(replace(role, '\', '')) + (length(role) - length(replace(role, '</turn>', ''))) // 7 + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x) - 2)), 0)) + (length(role) - length(replace(role, ':', ''))) + 2 + (length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)) + 8 as n
            from all_rows
        )
        select conv_id, count(*)::bigint as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
            coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '')) as loss_sha256,
            sum(n)::bigint as formatted_chars
        from shaped group by conv_id
    """,
}
