"""Which components of a document must be measured: the flagship plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query
from ..functions import cas as C
from ..functions import content as N
from ..operators.aggregates import gate_lock
from ..operators.joins import first_per_cas
from ..operators.predicates import _CHECK
from ..operators.scalars import _PREFIX, _VALUE, regulation_prefix


def measured_subjects(components: DataFrame, master: DataFrame) -> DataFrame:
    """doc_id, measured, others: labels of the components that must be measured, and of the rest, in order.

    The checksum is tested at the scan, duplicates meet in one aggregate by document and number, the master's first row of a
    number is joined (a small dimension, which Spark broadcasts by its size), and labels are put together by document.
    """
    valid = components.where(C.checksum_holds(F.col("cas"))).select("doc_id", "cas", "seq", "name", "content")
    kept = gate_lock(valid)
    known = first_per_cas(master).select("cas", F.col("name").alias("known"), "special", "permit", "exam", "measured")
    rows = kept.join(known, "cas", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("special", "permit", "exam", "measured")})
    label = F.concat(regulation_prefix(), F.coalesce("known", "name"), F.lit("["), "cas", F.lit("("), "content", F.lit(")]"))
    subject = F.col("measured") & (N.measured_value(F.col("content")) >= 1)
    item = F.struct("position", "cas", label.alias("label"))
    listed = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, item))), lambda x: x["label"]), "; ")
    return rows.groupBy("doc_id").agg(listed(subject).alias("measured"), listed(~subject).alias("others"))


@query("validate_measured_subjects", f"""
WITH k AS (SELECT doc_id, cas, name, content, min(seq) OVER (PARTITION BY doc_id, cas) AS position, row_number() OVER (PARTITION BY doc_id, cas ORDER BY CASE WHEN contains(content, '~') THEN 0 WHEN content NOT IN ('', '미기재%') THEN 1 ELSE 2 END, seq) AS n FROM component WHERE {_CHECK}),
f AS (SELECT cas, name AS known, special, permit, exam, measured FROM master QUALIFY row_number() OVER (PARTITION BY cas ORDER BY ord) = 1),
j AS (SELECT k.doc_id, k.cas, k.content, k.position, coalesce(f.known, k.name) AS shown, coalesce(special, false) AS special, coalesce(permit, false) AS permit, coalesce(exam, false) AS exam, coalesce(measured, false) AS measured FROM k LEFT JOIN f USING (cas) WHERE n = 1),
l AS (SELECT doc_id, cas, position, {_PREFIX} || shown || '[' || cas || '(' || content || ')]' AS label, measured AND coalesce(CASE WHEN {_VALUE} IS NULL THEN true WHEN contains(content, '<') AND {_VALUE} <= 1 THEN false ELSE {_VALUE} >= 1 END, false) AS subject FROM j)
SELECT doc_id, coalesce(string_agg(label, '; ' ORDER BY position, cas) FILTER (WHERE subject), '') AS measured, coalesce(string_agg(label, '; ' ORDER BY position, cas) FILTER (WHERE NOT subject), '') AS others FROM l GROUP BY doc_id""")
def validate(t: Tables) -> DataFrame:
    return measured_subjects(t.component, t.master)
