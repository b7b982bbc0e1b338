"""Sequence feature and count queries; documents are the sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import chunks, counts
from ..operators.pins import pinned
from .registry import query

UP = "translate(text, 'acgt', 'ACGT')"


def sequences(t):
    return t("documents").select("doc_id", "lang", "source", sc.fold_bases(F.col("text")).alias("seq"))


def _code(k):
    digit = lambda j: f"(strpos('ACGT', substr(w, {j}, 1)) - 1)"
    return f"case when regexp_matches(w, '^[ACGT]{{{{{k}}}}}$') then " .replace("{{", "{").replace("}}", "}") + " + ".join(f"{digit(j)} * {4 ** (k - j)}" for j in range(1, k + 1)) + f" else {4**k} end"


def letters(text="text", columns="doc_id, source"):
    return f"select {columns}, unnest(string_split({text}, '')) as c, unnest(range(1, length({text}) + 1)) as i from documents where length(text) > 0"


def _windows(k, text=UP, columns="doc_id, source"):
    word = " || ".join(["c", *(f"lead(c, {j}) over (partition by doc_id order by i)" for j in range(1, k))])
    return f"select * from (select {columns}, i, {word} as w from ({letters(text, columns)})) where w is not null"


@query(f"select cast({_code(2)} as bigint) as code, count(*) as n from ({_windows(2)}) group by 1")
def d2_dinucleotide_codes(t):
    return counts.kmer_counts(t("documents"), "text", 2, [])


@query(f"select source, cast({_code(4)} as bigint) as code, count(*) as n from ({_windows(4)}) group by 1, 2")
def e1_kmer_counts(t):
    return counts.kmer_counts(t("documents"), "text", 4, ["source"])


@query(f"""with w as (select source, w, count(*) as n from ({_windows(15, f"('NNNNNNN' || {UP} || 'NNNNNNN')")}) group by 1, 2),
k as (select source, unnest([2, 4, 6, 8]) as k, w, n from w),
o as (select source, '+' as strand, k, substr(w, 9 - k, k) as s, n from k union all select source, '-', k, reverse(translate(substr(w, 8, k), 'ACGTacgt', 'TGCAtgca')), n from k)
select source, strand, k, cast(case when regexp_matches(s, '^[ACGT]+$') then list_sum([(strpos('ACGT', substr(s, i, 1)) - 1) * power(4, k - i) for i in range(1, k + 1)])
  else power(4, k) end as bigint) as code,
  cast(sum(n) as bigint) as n from o group by 1, 2, 3, 4""")
def e1_oriented_kmers(t):
    """2-, 4-, 6- and 8-mers on both strands that end at each position, in one pass over chunks; N/edge is 4^k, so each strand and k counts every position once."""
    return chunks.oriented_kmers(chunks.of_texts(t("documents"), "text", ["source"], 7), (2, 4, 6, 8), ["source"])


@query(f"""with c as (select cast({_code(4)} as bigint) as code, count(*) as n from ({_windows(4)}) group by 1),
m as (select unnest([1, 2, 3]) as k, code, n from c)
select k, cast(case when code = 256 then power(4, k) else code % cast(power(4, k) as bigint) end as bigint) as parent, cast(sum(n) as bigint) as n from m group by 1, 2""")
def d5_suffix_marginals(t):
    c = counts.kmer_counts(t("documents"), "text", 4, [])
    m = c.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    size = F.pow(F.lit(4), F.col("k")).cast("long")
    return m.groupBy("k", F.when(F.col("code") == 256, size).otherwise(F.col("code") % size).alias("parent")).agg(F.sum("n").alias("n"))


@query(f"""with c as (select doc_id, {UP} as s from documents), n as (select doc_id, length(s) as len, length(s) - length(replace(s, 'A', '')) as a, length(s) -
  length(replace(s, 'C', '')) as c, length(s) - length(replace(s, 'G', '')) as g, length(s) - length(replace(s, 'T', '')) as t from c)
select doc_id, len as length, round(case when a + c + g + t > 0 then (c + g) / (a + c + g + t) end, 10) as gc, round((len - a - c - g - t) / nullif(len, 0), 10) as n_share,
  round(case when a + c + g + t > 0 then -(case when a > 0 then a / (a + c + g + t) * log2(a / (a + c + g + t)) else 0 end + case when c > 0 then c / (a + c + g + t) *
  log2(c / (a + c + g + t)) else 0 end
   + case when g > 0 then g / (a + c + g + t) * log2(g / (a + c + g + t)) else 0 end + case when t > 0 then t / (a + c + g + t) * log2(t / (a + c + g + t)) else 0 end) end, 8) as entropy from n""")
def d11_sequence_stats(t):
    rows = counts.letter_counts(t("documents"), "text", ["doc_id"])
    all_bases = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    gc = F.when(all_bases > 0, (F.col("c") + F.col("g")) / all_bases)
    return rows.select("doc_id", "length", F.round(gc, 10).alias("gc"), F.round(F.try_divide(F.col("length") - all_bases, "length"), 10).alias("n_share"), F.round(sc.entropy([F.col(x) for x in "acgt"]), 8).alias("entropy"))


@query("""with w as (select doc_id, chr.i as pos, case when regexp_matches(chr.c, '[CGcg]') then 1 else 0 end as gc, case when regexp_matches(chr.c, '[ACGTacgt]') then 1 else 0 end as valid
  from (select doc_id, unnest(string_split(text, '')) as c, unnest(range(1, length(text) + 1)) as i from documents) chr),
s as (select doc_id, pos, sum(gc) over (partition by doc_id order by pos range between 50 preceding and 50 following) as gc, sum(valid) over (partition by doc_id order
  by pos range between 50 preceding and 50 following) as valid from w)
select doc_id, cast(sum(gc) as bigint) as gc, cast(sum(valid) as bigint) as valid, max(gc) as top from s group by 1""")
def d6_window_composition(t):
    """Centred windows by running sums over chunks: the sum over positions of the window counts, and the largest."""
    return chunks.window_sums(chunks.of_texts(t("documents"), "text", ["doc_id"], 50), 50, ["doc_id"]).select("doc_id", "gc", "valid", F.col("most_gc").alias("top"))


@query("""select case when l_discount >= 0.08 then 4 when l_discount >= 0.06 then 3 when l_discount >= 0.03 then 2 when l_discount >= 0.01 then 1 else 0 end as code, count(*) as n,
  cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as positive from lineitem group by 1""")
def d7_fixed_bins(t):
    rows = t("lineitem").select(sc.bin_code(F.col("l_discount"), [0.01, 0.03, 0.06, 0.08]).alias("code"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.sum("y").alias("positive"))


@query(f"""with s as (select doc_id, {UP} as s from documents), n as (select doc_id, length(s) - length(replace(s, 'C', '')) as c, length(s) - length(replace(s, 'G',
  '')) as g, (length(s) - length(replace(s, 'CG', ''))) / 2 as p,
 length(s) - length(replace(replace(replace(replace(s, 'A', ''), 'C', ''), 'G', ''), 'T', '')) as v from s)
select doc_id, round(case when c * g > 0 then p * v / (c * g) end, 10) as observed_expected from n""")
def d8_pair_observed_expected(t):
    s = F.col("seq")
    pair = (F.length(s) - F.length(F.replace(s, F.lit("CG"), F.lit("")))) / 2
    n = lambda x: sc.letter_count(s, x).cast("double")
    return sequences(t).select("doc_id", F.round(sc.observed_expected(n("C"), n("G"), pair, n("ACGT")), 10).alias("observed_expected"))


@query(f"""with b as (select source, word, count(*) as n from (select source, w as word from ({_windows(2, "text")})) group by 1, 2),
f as (select source, word, n / sum(n) over (partition by source) as f from b), c as (select word, sum(f) / (select count(distinct source) from documents) as f from f group by 1)
select source, round(sum(f.f * c.f) / (sqrt(sum(f.f * f.f)) * (select sqrt(sum(f * f)) from c)), 8) as cosine from f join c using (word) group by 1""")
def d12_centroid_cosine(t):
    b = pinned(counts.word_counts(t("documents"), "text", 2, ["source"]))
    f = b.join(b.groupBy("source").agg(F.sum("n").alias("all")), "source").select("source", "word", (F.col("n") / F.col("all")).alias("f"))
    groups = t("documents").agg(F.countDistinct("source").alias("groups"))
    c = f.groupBy("word").agg(F.sum("f").alias("s")).crossJoin(F.broadcast(groups)).select("word", (F.col("s") / F.col("groups")).alias("c"))
    size = c.agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("size"))
    out = f.join(c, "word").groupBy("source").agg(F.sum(F.col("f") * F.col("c")).alias("dot"), F.sqrt(F.sum(F.col("f") * F.col("f"))).alias("own"))
    return out.crossJoin(F.broadcast(size)).select("source", F.round(F.col("dot") / (F.col("own") * F.col("size")), 8).alias("cosine"))


@query("""select l_orderkey, l_linenumber, round(1 / (1 + exp(-l_tax)), 10) as sigmoid, round(ln((0.1 + l_tax) / (1 - (0.1 + l_tax))), 10) as logit, round(ln(1 + exp(l_tax)), 10) as softplus, round(log2((l_quantity + 1) / (l_tax + 1)), 10) as ratio from lineitem""")
def d16_scalar_maths(t):
    x = F.col("l_tax")
    return t("lineitem").select("l_orderkey", "l_linenumber", *(F.round(c, 10).alias(n) for n, c in (("sigmoid", sc.sigmoid(x)), ("logit", sc.logit(x + 0.1)), ("softplus", sc.softplus(x)), ("ratio", sc.log2_ratio(F.col("l_quantity"), x)))))


@query(f"""with b as (select lang, w as word from ({_windows(3, "text", "doc_id, lang")})),
n as (select word, count(*) filter (where lang = 'en') as a, count(*) filter (where lang <> 'en') as b from b group by 1)
select word, a as en, b as other, round(log2((a + 1) / (b + 1)), 10) as log_ratio from n order by a desc, word limit 50""")
def e14_cohort_kmers(t):
    rows = counts.word_counts(t("documents"), "text", 3, ["lang"])
    of = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0)).alias
    n = rows.groupBy("word").agg(of(F.col("lang") == "en")("en"), of(F.col("lang") != "en")("other"))
    return n.withColumn("log_ratio", F.round(sc.log2_ratio(F.col("en"), F.col("other")), 10)).orderBy(F.desc("en"), "word").limit(50)


#: Every letter but A, C, G and T is N, and so is what lies outside the text.
FOLDED = f"regexp_replace({UP}, '[^ACGT]', 'N', 'g')"
RUN = 1 << 20


def folded(c: Column) -> Column:
    return F.regexp_replace(sc.fold_bases(c), "[^ACGT]", "N")


def _contexts(half: int):
    """Of texts of A, C, G, T and N: how often each window of 2 * half + 1 letters stands around a letter, N outside; windows as base-5 codes."""
    digit, gap = np.zeros(256, np.int32), b"N" * half
    digit[np.frombuffer(b"ACGTN", np.uint8)] = range(5)

    def count(texts):
        data = digit[np.frombuffer(gap + gap.join(texts) + gap, np.uint8)]
        code = np.zeros(len(data) - 2 * half, np.int32)
        for j in range(2 * half + 1):
            code = code * 5 + data[j : j + len(code)]
        length = np.array([len(t) for t in texts])
        centre = np.zeros(len(code) + 1, np.int32)
        start = np.cumsum(length + half) - length - half
        np.add.at(centre, start, 1)
        np.add.at(centre, start + length, -1)
        codes, n = np.unique(code[centre[:-1].cumsum() > 0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(n, pa.int64())], ["code", "n"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for t in b.column(0):
                held.append(t.as_py().encode())
                size += len(held[-1])
                if size >= RUN:
                    yield count(held)
                    held, size = [], 0
        if held:
            yield count(held)

    return run


@query(f"""with c as (select w, count(*) as n from ({_windows(11, f"('NNNNN' || {FOLDED} || 'NNNNN')", "doc_id")}) group by 1)
select '+' as strand, w as context, n from c union all select '-', reverse(translate(w, 'ACGT', 'TGCA')), n from c""")
def d1_contexts_everywhere(t):
    """The oriented contexts of five letters each way around every position of each text, on both strands: how often each stands there."""
    rows = t("documents").where(F.length("text") > 0).select(folded(F.col("text")).alias("seq"))
    c = rows.mapInArrow(_contexts(5), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    letter = lambda k: F.substring(F.lit("ACGTN"), (F.floor(F.col("code") / 5**k) % 5 + 1).cast("int"), F.lit(1))
    c = c.select(F.concat(*(letter(k) for k in range(10, -1, -1))).alias("w"), "n")
    both = F.array(F.struct(F.lit("+").alias("strand"), F.col("w").alias("context")), F.struct(F.lit("-").alias("strand"), sc.reverse_complement(F.col("w")).alias("context")))
    return c.select(F.explode(both).alias("s"), "n").select("s.strand", "s.context", "n")


def offset_bases(rows: DataFrame, keys: list[str], half: int) -> DataFrame:
    """keys, at, base, n: of seq in each row, how many positions have the base at the offset, N outside.

    At offset o > 0 that is all of the text but its first o letters, at o < 0 all but its last, and as many N as lie outside."""
    rows = rows.select(*keys, F.left("seq", F.lit(half)).alias("head"), F.right("seq", F.lit(half)).alias("tail"), *(sc.letter_count(F.col("seq"), b).alias(f"_{b}") for b in "ACGTN"), F.length("seq").alias("_len"))
    n, o = F.col("_len"), F.col("at")
    left = F.least(F.abs(o), n)
    lost = F.when(o > 0, F.left("head", left)).otherwise(F.right("tail", left))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("lost", lost).withColumn("out", left)
    count = lambda b: F.col(f"_{b}") - sc.letter_count(F.col("lost"), b) + (F.col("out") if b == "N" else 0)
    rows = rows.select(*keys, F.col("at").cast("long").alias("at"), F.explode(F.array(*(F.struct(F.lit(b).alias("base"), count(b).cast("long").alias("n")) for b in "ACGTN"))).alias("x"))
    return rows.select(*keys, "at", "x.base", "x.n").where("n > 0")


def _offsets(half, columns, rows="documents"):
    """Each letter of a padded text as the base at each offset of the position that it stands by, if that lies in the text."""
    pad = "N" * half
    return f"""select {columns}, o, c as base from (select {columns}, len, unnest(string_split(s, '')) as c, unnest(range(1, len + {2 * half + 1})) as j
 from (select {columns}, length(text) as len, '{pad}' || {FOLDED} || '{pad}' as s from {rows} where length(text) > 0)), (select unnest(range({-half}, {half + 1})) as o)
  where j - {half} - o between 1 and len"""


@query(f"select doc_id, cast(o as bigint) as at, base, count(*) as n from ({_offsets(3, 'doc_id')}) where base <> 'A' group by 1, 2, 3")
def d3_bases_everywhere(t):
    """The ones of the one-hot code at offsets -3 to 3 of every position, summed over each text: A is the reference and has no row."""
    rows = t("documents").where(F.length("text") > 0).select("doc_id", folded(F.col("text")).alias("seq"))
    return offset_bases(rows, ["doc_id"], 3).where("base <> 'A'").groupBy("doc_id", "at", "base").agg(F.sum("n").alias("n"))


@query(f"""with n as (select o, base, count(*) filter (where y = 1) as ones, count(*) filter (where y = 0) as zeros from
  ({_offsets(20, "y", "(select text, quality as y from documents join labels using (doc_id))")}) group by 1, 2),
s as (select *, ones / nullif(sum(ones) over (partition by o), 0) as p, zeros / nullif(sum(zeros) over (partition by o), 0) as q from n)
select cast(o as bigint) as at, base, ones, zeros, round(log2((p + 1e-6) / (q + 1e-6)), 8) as log2_enrichment from s""")
def e13_bases_everywhere(t):
    """Base counts by class at offsets -20 to 20 of every position of each labelled text, and the log2 enrichment of their shares."""
    rows = t("documents").where(F.length("text") > 0).join(t("labels"), "doc_id").select(F.col("quality").alias("y"), folded(F.col("text")).alias("seq"))
    of = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    n = offset_bases(rows, ["y"], 20).groupBy("at", "base").agg(of(1).alias("ones"), of(0).alias("zeros"))
    total = n.groupBy("at").agg(F.sum("ones").alias("all_ones"), F.sum("zeros").alias("all_zeros"))
    share = lambda c: F.try_divide(c, f"all_{c}") + 1e-6
    return n.join(F.broadcast(total), "at").select("at", "base", "ones", "zeros", F.round(F.log2(share("ones") / share("zeros")), 8).alias("log2_enrichment"))
