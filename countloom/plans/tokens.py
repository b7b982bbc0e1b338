"""Tokens by a given list of merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks, merges
from .registry import query
from .sequences import FOLDED
from .sites import SITES, event_sites

#: A given list of merges, by rank; nothing is trained.
MERGES = [("T", "A"), ("A", "C"), ("G", "T"), ("C", "C"), ("A", "A"), ("AC", "GT"), ("TA", "TA"), ("N", "N"), ("AA", "N"), ("NN", "NN"), ("CC", "A")]
#: Letters of a chunk; no token crosses its edge.
WIDTH = 1000


def _merged(text: str) -> str:
    """SQL: tokens in angle brackets."""
    out = f"regexp_replace({text}, '(.)', '<\\1>', 'g')"
    for a, b in MERGES:
        out = f"replace({out}, '<{a}><{b}>', '<{a}{b}>')"
    return out


PIECES = f"(select doc_id, source, c * {WIDTH} as core, substr(seq, c * {WIDTH} + 1, {WIDTH}) as s from (select doc_id, source, {FOLDED} as seq, unnest(range(0, (length(text) + {WIDTH - 1}) // {WIDTH})) as c from documents where length(text) > 0))"
LISTS = f"(select doc_id, source, core, regexp_extract_all({_merged('s')}, '<([A-Z]+)>', 1) as l from {PIECES})"
TOKENS = f"(select doc_id, source, core, unnest(l) as token, unnest(range(0, len(l))) as i from {LISTS})"


@query(f"select source, token, count(*) as n from {TOKENS} group by 1, 2")
def d14_token_counts(t):
    """How often each token stands in the texts of each source."""
    return merges.token_counts(chunks.of_texts(t("documents"), "text", ["source"], 0, WIDTH), MERGES, ["source"])


@query(f"""with e as (select doc_id, core, i, token, core + sum(length(token)) over (partition by doc_id, core order by i) as stop from {TOKENS} where doc_id in (select user_id from events))
select event_id, token, cast(stop - length(token) as bigint) as token_start, cast(stop as bigint) as token_end from {SITES} s join e on e.doc_id = s.doc_id and pos >= stop - length(token) and pos < stop""")
def d14_tokens_at_sites(t):
    """The token that holds each event's place, and where it begins and ends."""
    asked = t("events").select(F.col("user_id").alias("doc_id")).distinct()
    rows = chunks.of_texts(t("documents").join(asked, "doc_id", "left_semi"), "text", ["doc_id"], 0, WIDTH)
    return merges.tokens_at(rows, event_sites(t), "doc_id", MERGES, WIDTH).select("event_id", "token", "token_start", "token_end")


@query(f"""with p as (select token as first, lead(token) over (partition by doc_id, core order by i) as second from {TOKENS}) select first, second, count(*) as n from p where second is not null group by 1, 2""")
def d13_pair_counts(t):
    """How often two tokens stand side by side: what a next merge would be chosen by. No merge is learned here."""
    return merges.pair_counts(chunks.of_texts(t("documents"), "text", [], 0, WIDTH), MERGES, [])
