"""op2: the documents mixed to target weights of their sources."""

from alertweft.llm import mixing
from alertweft.llm.common import table
from alertweft.llm.registry import query

#: target shares: the dominant source is brought down, three others are given fixed shares
WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src7": 0.05}
REST = 0.55

SQL = """
WITH d AS (
    SELECT *, CASE WHEN source IN ('src0', 'src1', 'src2', 'src7') THEN source ELSE '*' END AS cls,
        coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS who FROM documents),
b AS (SELECT cls, CAST(sum(coalesce(octet_length(encode(text)), 0) + 1) AS BIGINT) AS bytes FROM d GROUP BY cls),
r AS (
    SELECT cls, (CASE cls WHEN 'src0' THEN 0.2::DOUBLE WHEN 'src1' THEN 0.1::DOUBLE WHEN 'src2' THEN 0.1::DOUBLE
        WHEN 'src7' THEN 0.05::DOUBLE ELSE 0.55::DOUBLE END) * (SELECT sum(bytes) FROM b)::BIGINT / bytes AS rate FROM b),
k AS (SELECT cls, rate, CAST(unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 24) AS BIGINT) + 1)) AS BIGINT) AS k FROM r),
p AS (
    SELECT cls, k, exp(-rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate) - ln(k) END)
        OVER (PARTITION BY cls ORDER BY k)) AS p FROM k),
c AS (SELECT cls, k, sum(p) OVER (PARTITION BY cls ORDER BY k) AS c FROM p),
n AS (
    SELECT d.*, (SELECT count(*) FROM c WHERE c.cls = d.cls
        AND c.c <= CAST('0x' || substr(md5('mix|' || who), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE) AS n_copies FROM d),
x AS (SELECT *, unnest(range(1, n_copies + 1)) AS cp FROM n)
SELECT doc_id, text, lang, source, n_chars, CAST(n_copies AS INTEGER) AS n_copies, CAST(cp AS INTEGER) AS copy,
    substr(md5('mix|' || who || '|' || cp), 1, 16) AS shuffle_key FROM x"""


@query("op2_mixing", SQL)
def op2_mixing(spark, folder):
    """Every copy of every document, shuffled, at the weights above."""
    return mixing.replicate(table(spark, folder, "documents"), WEIGHTS, REST)
