"""Queries of text features, models and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import numeric
from tesserae.operators import features, metrics, models
from tesserae.plans.registry import query


@query("""with w as (select record_id, list_filter(regexp_split_to_array(lower(regexp_replace(strip_accents(coalesce(title_clean, '')), '[^\\x00-\\x7F]', ' ', 'g')), '[^a-z0-9_]+'), lambda x: length(x) >= 2) as w from $awards),
    g as (select record_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)::bigint), lambda i: w[i] || ' ' || w[i + 1]))) as term from w), c as (select record_id, term, count(*) as tf from g group by 1, 2),
    v as (select term, count(*) as df from c group by 1 having count(*) >= 2), x as (select record_id, term, (1 + ln(tf)) * (ln((1.0 + (select count(*) from $awards)) / (1 + df)) + 1) as w from c join v using (term))
    select record_id, term, round(w / sqrt(sum(w * w) over (partition by record_id)), 6) as weight from x""")
def tfidf(t):
    rows = t.awards.withColumn("title_clean", F.regexp_replace("title_clean", r"[\x{00A0}\x{2000}-\x{206F}\x{00AD}\x{FEFF}]", " "))
    return features.tfidf(rows, "record_id", "title_clean").withColumn("weight", F.round("weight", 6))


@query("""with k as (select nsforganization as v from $awards where nsforganization is not null group by 1 order by count(*) desc, 1 limit 5) select record_id, coalesce((nsforganization = 'DUE')::int, 0)::double as org_DUE, (nsforganization is not null and nsforganization not in ('DUE', 'DRL'))::int::double as org_OTHER from $awards""")
def topk_multi_hot(t):
    listed = F.when(F.col("nsforganization").isNotNull(), F.array("nsforganization")).otherwise(F.array().cast("array<string>"))
    due, _, other = numeric.multi_hot(listed, ["DUE", "DRL"], "org")
    return t.awards.select("record_id", due, other)


@query("select candidate_stratum, count(*) as n, sum(count(*)) over () / (count(*) over () * count(*))::double as weight from $flagged where candidate_stratum is not null group by 1")
def class_weights(t):
    return numeric.class_weights(t.flagged, "candidate_stratum")


def _scored(t):
    """Scored rows: the score is made from the nine digits after ``bm_``, as in the SQL, whatever their size; of an id of another form from its last digits, of one without digits from its hash."""
    key = F.col("benchmark_id")
    number = F.coalesce(key.substr(4, 9).try_cast("bigint"), F.regexp_extract(key, r"([0-9]{1,9})[^0-9]*$", 1).try_cast("bigint"), F.when(key.isNotNull(), F.xxhash64(key)))
    score = F.pmod(F.pmod(number, F.lit(50)) * 37, F.lit(50)) / 50.0
    return t.benchmark.where("target_mmr_binary is not null").select(F.col("target_mmr_binary").alias("y_true"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("y_pred"))


_SCORED = "(select target_mmr_binary as y_true, (substr(benchmark_id, 4, 9)::int * 37 % 50) / 50.0::double as score, ((substr(benchmark_id, 4, 9)::int * 37 % 50) / 50.0 >= 0.5)::int as y_pred from $benchmark where target_mmr_binary is not null)"


@query(f"select y_true, y_pred, count(*) as n from {_SCORED} group by 1, 2")
def confusion(t):
    return metrics.confusion_counts(_scored(t))


@query("""with c as (select label_mmr_class as y, case when label_qual_signal = 'yes' and label_quant_signal = 'yes' then 'implicit_mmr' when label_qual_signal = 'yes' then 'qual_only' when label_quant_signal = 'yes' then 'quant_only' else 'no_method_signal' end as p from $benchmark where label_mmr_class is not null),
    l as (select distinct y as label from c union select distinct p from c) select label, coalesce(count(*) filter (where y = label and p = label) / nullif(count(*) filter (where p = label), 0)::double, 0) as precision, coalesce(count(*) filter (where y = label and p = label) / nullif(count(*) filter (where y = label), 0)::double, 0) as recall,
    coalesce(2.0 * count(*) filter (where y = label and p = label) / nullif(count(*) filter (where y = label) + count(*) filter (where p = label), 0), 0)::double as f1, count(*) filter (where y = label) as support from l, c group by 1""")
def f1_report(t):
    return metrics.class_report(metrics.confusion_counts(_labelled(t)))


def _labelled(t):
    qual, quant = F.col("label_qual_signal") == "yes", F.col("label_quant_signal") == "yes"
    pred = F.when(qual & quant, "implicit_mmr").when(qual, "qual_only").when(quant, "quant_only").otherwise("no_method_signal")
    return t.benchmark.select(F.col("label_mmr_class").alias("y_true"), pred.alias("y_pred"))


@query()
def metric_summary(t):
    return metrics.binary_metrics(_scored(t), score="score")


@query("""with s as (select benchmark_id, label_mmr_class as y, case when label_qual_signal = 'yes' then 'qual_only' else 'no_method_signal' end as p from $benchmark)
    select l.label as y_true, count(*) filter (where y = l.label and p = 'qual_only') as qual_only, count(*) filter (where y = l.label and p = 'no_method_signal') as no_method_signal from (values ('qual_only'), ('no_method_signal')) l(label), s group by 1""")
def confusion_matrix(t):
    rows = t.benchmark.select(F.col("label_mmr_class").alias("y_true"), F.when(F.col("label_qual_signal") == "yes", "qual_only").otherwise("no_method_signal").alias("y_pred"))
    return metrics.confusion_matrix(rows, ["qual_only", "no_method_signal"])


@query(f"""with p as (select score from {_SCORED} where y_true = 1), n as (select score from {_SCORED} where y_true = 0), g as (select score, sum(y_true) as pos, count(*) as a from {_SCORED} group by 1), c as (select *, sum(pos) over (order by score desc) as tp, sum(a) over (order by score desc) as seen from g)
    select (select count(*) from {_SCORED}) as n, (select count(*) from p) as n_pos, (select avg(case when p.score > n.score then 1.0 when p.score = n.score then 0.5 else 0 end) from p, n) as roc_auc, (select sum(pos / (select count(*) from p)::double * tp / seen) from c) as average_precision""")
def ranking_metrics(t):
    return metrics.ranking_metrics(_scored(t))


@query(f"""select threshold, avg((y_true = (score >= threshold)::int)::int) as accuracy, coalesce(2.0 * sum(y_true * (score >= threshold)::int) / nullif(sum(y_true) + sum((score >= threshold)::int), 0), 0)::double as f1_pos
    from {_SCORED}, (values (0.05::double), (0.275::double), (0.5::double), (0.725::double), (0.95::double)) v(threshold) group by 1""")
def threshold_sweep(t):
    grid = [0.05 + 0.9 * k / 4 for k in range(5)]
    return metrics.threshold_sweep(_scored(t), [round(g, 3) for g in grid]).select("threshold", "accuracy", "f1_pos")


@query("select label, (row_number() over (order by label) - 1)::int as idx from (select distinct label_mmr_class as label from $benchmark where label_mmr_class is not null)")
def label_encoding(t):
    return metrics.label_index(t.benchmark, "label_mmr_class")


@query()
def lr_scores(t):
    rows = t.benchmark.withColumn("split", F.lower(F.trim("split_random_cluster_stratified"))).withColumn("x", F.concat_ws(" ", "title_clean", "abstract_clean"))
    model, labels = models.text_classifier(rows.where("split = 'train' and label_mmr_class is not null").select("x", "label_mmr_class"), "x", "label_mmr_class")
    return models.classify(model, rows.where("split = 'test'").select("benchmark_id", "x", "label_mmr_class"), "x", labels).select("benchmark_id", F.col("label_mmr_class").alias("y_true"), "y_pred")


@query()
def mixed_preprocessing(t):
    rows = features.bucket_rare(t.awards.select("record_id", "award_amount", "team_size", "state"), ["state"])
    fitted = features.preprocessing(["award_amount", "team_size"], ["state"]).fit(rows)
    from pyspark.ml.functions import vector_to_array

    return fitted.transform(rows).select("record_id", F.size(vector_to_array("features")).alias("width"))


@query("select record_id, case when n < 3 then '__rare__' else s end as state from (select record_id, coalesce(nullif(trim(state), ''), '__missing__') as s, count(*) over (partition by coalesce(nullif(trim(state), ''), '__missing__')) as n from $awards)")
def rare_categories(t):
    return features.bucket_rare(t.awards.select("record_id", "state"), ["state"], 3)
