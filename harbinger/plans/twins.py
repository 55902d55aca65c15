"""DuckDB text of the derived inputs and of steps that several checks share."""

from __future__ import annotations

# name -> (names it reads, query text)
STEPS: dict[str, tuple[list[str], str]] = {}


def step(name: str, text: str, *reads: str) -> None:
    STEPS[name] = (list(reads), text.strip())


def sql(body: str, *reads: str) -> str:
    """``WITH`` clause of the named steps and everything they read, then ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in STEPS[name][0]:
            visit(dep)
        order.append(name)

    for name in reads:
        visit(name)
    if not order:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({STEPS[n][1]})" for n in order) + "\n" + body.strip()


step(
    "articles",
    """
    SELECT doc_id AS article_id, doc_id AS ingest_pos,
           TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INT)) AS pub,
           TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INT))
             + to_hours(CAST(doc_id % 5 * 3 AS INT)) AS pub_tod,
           split_part(text, chr(10), 1) AS title,
           substr(text, length(split_part(text, chr(10), 1)) + 2) AS description
    FROM documents
    """,
)
step(
    "shares",
    """
    SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS article_id,
           CAST(user_id AS VARCHAR) AS author_id, CAST(ts AS TIMESTAMP) AS created_at,
           value AS followers_count, CAST(event_id % 1000 AS DOUBLE) AS tweet_count,
           CAST(event_id % 17 AS DOUBLE) AS listed_count
    FROM events
    """,
)
step(
    "vectors",
    """
    SELECT m AS model, vec_id AS article_id,
           CAST(list_slice(embedding, m * 16 + 1, m * 16 + 16) AS DOUBLE[]) AS coords
    FROM embeddings, (SELECT CAST(unnest(range(4)) AS INT) AS m)
    """,
)
step(
    "snapshots",
    """
    SELECT model, article_id, pub, snapshot_date, topic AS cluster_id, topic AS topic_id,
           topic = -1 AS is_outlier, ((article_id * 37 + model * 11) % 100) / 100.0::DOUBLE AS outlier_score
    FROM (
      SELECT m AS model, vec_id AS article_id, pub, sd AS snapshot_date,
             CASE WHEN sd < DATE '2024-01-01' + CAST((label * 3 + m * 2) % 25 AS INT) THEN -1
                  WHEN (vec_id * 7 + m * 13) % 10 < 6
                       AND sd < pub + CAST((vec_id * 11 + m * 5) % 12 AS INT) THEN -1
                  ELSE label END AS topic
      FROM (SELECT vec_id, label, DATE '2024-01-01' + CAST(vec_id % 30 AS INT) AS pub FROM embeddings),
           (SELECT CAST(unnest(range(4)) AS INT) AS m),
           (SELECT DATE '2024-01-01' + CAST(unnest(range(30)) AS INT) AS sd)
      WHERE sd >= pub
    )
    """,
)
step(
    "kept",
    """
    SELECT s.* FROM snapshots s
    JOIN (SELECT model, min(snapshot_date) AS start FROM snapshots GROUP BY model) b USING (model)
    WHERE s.snapshot_date >= b.start + 5
    """,
    "snapshots",
)
step(
    "births",
    "SELECT model, topic_id, min(snapshot_date) AS topic_time FROM kept WHERE topic_id >= 0 GROUP BY ALL",
    "kept",
)
step(
    "at_pub",
    """
    SELECT model, article_id, pub, snapshot_date AS ta, (is_outlier OR topic_id = -1) AS out_at_pub
    FROM kept WHERE snapshot_date >= pub
    QUALIFY row_number() OVER (PARTITION BY model, article_id ORDER BY snapshot_date) = 1
    """,
    "kept",
)
step(
    "joins",
    """
    SELECT k.model, k.article_id, k.snapshot_date AS join_time, k.topic_id AS join_topic
    FROM kept k JOIN at_pub a USING (model, article_id)
    WHERE k.snapshot_date >= a.ta AND k.topic_id >= 0
    QUALIFY row_number() OVER (PARTITION BY k.model, k.article_id ORDER BY k.snapshot_date) = 1
    """,
    "kept",
    "at_pub",
)
step(
    "trajectories",
    """
    SELECT a.model, a.article_id, a.pub, a.ta, CAST(a.out_at_pub AS INT) AS outlier,
           CASE WHEN NOT out_at_pub THEN 'not_publication_outlier'
                WHEN join_time IS NULL THEN 'Oold'
                WHEN a.pub < topic_time AND topic_time = join_time THEN 'TOAfirst'
                WHEN a.pub < topic_time AND topic_time < join_time THEN 'TOAlate'
                WHEN topic_time <= a.pub AND a.pub < join_time THEN 'TODlate'
                ELSE 'other' END AS trajectory,
           CASE WHEN out_at_pub THEN join_topic END AS first_topic_id,
           CASE WHEN out_at_pub THEN topic_time END AS first_topic_time,
           CASE WHEN out_at_pub THEN join_time END AS integration_time
    FROM at_pub a LEFT JOIN joins j USING (model, article_id)
    LEFT JOIN births b ON b.model = a.model AND b.topic_id = j.join_topic
    """,
    "at_pub",
    "joins",
    "births",
)
step(
    "totals",
    """
    SELECT article_id, pub, CAST(sum(outlier) AS BIGINT) AS n_outlier_votes,
           CAST(sum(CASE WHEN trajectory LIKE 'TOA%' THEN 1 ELSE 0 END) AS BIGINT) AS n_toa_votes,
           (SELECT count(DISTINCT model) FROM trajectories) AS n_models
    FROM trajectories GROUP BY article_id, pub
    """,
    "trajectories",
)
step(
    "labels_long",
    """
    SELECT t.*, k AS agreement_k,
           CASE WHEN n_outlier_votes < k THEN NULL WHEN n_toa_votes >= k THEN 1.0
                WHEN n_toa_votes <= 0 THEN 0.0 END::DOUBLE AS label_toa
    FROM totals t, (SELECT CAST(unnest(range(1, 5)) AS INT) AS k)
    """,
    "totals",
)
step(
    "raw_articles",
    """
    SELECT CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id // 2 AS VARCHAR) END AS article_id,
           doc_id AS ingest_pos, lang,
           CASE WHEN doc_id % 7 = 3 THEN NULL ELSE
             TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INT)) + to_hours(CAST(doc_id % 5 * 3 AS INT))
             - to_hours(CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 0 END) END AS pub
    FROM documents
    """,
)
step(
    "records",
    r"""
    SELECT *, substr(sha1(coalesce(nullif(media_url, ''), title)), 1, 16) AS article_id,
           trim(title || '. ' || lead_paragraph, '. ') AS embedding_text,
           lower(replace(regexp_extract(media_url, '^[a-z]+://([^/?#]*)', 1), 'www.', '')) AS domain
    FROM (
      SELECT page_id, 'changement climatique' AS query, strftime(moment, '%Y-%m-%d') AS collection_day,
             strftime(moment, '%Y-%m-%d') AS publication_date, title, description, body_text,
             CASE WHEN body_text <> '' THEN body_text ELSE description END AS lead_paragraph, media_url,
             CASE page_id % 3 WHEN 0 THEN 'Paper ' WHEN 1 THEN 'Herald ' ELSE 'Gazette ' END || (page_id % 9) AS source,
             CASE WHEN page_id % 3 = 0 THEN strftime(moment, '%a, %d %b %Y %H:%M:%S GMT') ELSE '' END AS raw_published
      FROM (
        SELECT page_id, TIMESTAMP '2025-04-02 07:00:00' + to_days(CAST(page_id % 54 AS INT)) AS moment,
               trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1),
                 '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) AS title,
               CASE WHEN page_id % 3 = 2 THEN 'about ' || page_id ELSE '' END AS description,
               CASE WHEN page_id % 5 <> 0 THEN
                 trim(regexp_replace(regexp_replace(html, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'),
                   '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) ELSE '' END AS body_text,
               regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''),
                 '([?&])utm_[^=&]*=[^&]*&?', '\1', 'gi'), '[?&]$', '') AS media_url
        FROM pages))
    """,
)
step(
    "posts",
    """
    SELECT event_id // 100 AS page_id, event_id, user_id, event_type, CAST(ts AS TIMESTAMP) AS ts,
           user_id % 10 <> 9 AS has_user FROM events
    """,
)


def values(rows) -> str:
    return "VALUES " + ", ".join(
        "(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in row) + ")" for row in rows
    )


from harbinger.plans.inputs import GAZETTEER, LEXICON  # noqa: E402

BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
step("texts", f"SELECT article_id, trim(title || ' ' || description, {BLANKS}) AS text FROM articles", "articles")
step(
    "measures",
    r"""
    SELECT article_id, round(coalesce(list_avg(list_transform(parts, lambda p: len(regexp_extract_all(p, '[\p{L}\p{N}_]+')))), 0), 6)
             AS avg_sentence_len_words,
           round(coalesce(list_avg(list_transform(words, lambda w: length(w))), 0), 6) AS avg_word_len_chars,
           coalesce(list_sum(syl), 0)::DOUBLE AS total_syllables, round(coalesce(list_avg(syl), 0), 6) AS avg_syllables_per_word,
           length(text)::DOUBLE AS len_chars, len(words)::DOUBLE AS len_words
    FROM (SELECT *, list_transform(words, lambda w: CASE WHEN regexp_matches(w, '\p{L}') THEN
              greatest(len(regexp_extract_all(lower(w), '[aeiouyàâäéèêëïîôöùûüÿœ]+')), 1) ELSE 0 END) AS syl
          FROM (SELECT article_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS words,
                  list_filter(string_split_regex(text, '[.!?]+'),
                    lambda p: regexp_matches(p, '[^\s\x0b\x1c-\x1f\x85\p{Z}]')) AS parts FROM texts))
    """,
    "texts",
)
step(
    "sentiment",
    r"""
    SELECT article_id, CASE WHEN text = '' THEN 0 ELSE coalesce(subj, 0) END AS text_subjectivity,
           CASE WHEN text = '' THEN 0 ELSE 1 - abs(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15)) END
             AS text_neutrality
    FROM texts LEFT JOIN (
      SELECT article_id, avg(subjectivity) AS subj, sum(valence) AS s
      FROM (SELECT article_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM texts)
      JOIN ("""
    + values(LEXICON)
    + """) AS lex(token, subjectivity, valence) USING (token) GROUP BY article_id) USING (article_id)
    """,
    "texts",
)
step(
    "mentions",
    r"""
    SELECT article_id, phrase AS ent_text, label FROM (
      SELECT article_id, unnest(list_concat(words,
        list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
        list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS phrase
      FROM (SELECT article_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS words FROM texts))
    JOIN ("""
    + values(GAZETTEER)
    + """) AS gaz(phrase, label) USING (phrase)
    """,
    "texts",
)
step(
    "entities",
    """
    SELECT article_id, coalesce(total, 0)::DOUBLE AS ner_total_ents, coalesce(forms, 0)::DOUBLE AS ner_distinct_ents,
           coalesce(per, 0)::DOUBLE AS ner_person, coalesce(org, 0)::DOUBLE AS ner_org,
           coalesce(loc, 0)::DOUBLE AS ner_loc, coalesce(misc, 0)::DOUBLE AS ner_misc
    FROM articles LEFT JOIN (
      SELECT article_id, count(*) AS total, count(DISTINCT ent_text) AS forms,
             count_if(label IN ('PER', 'PERSON')) AS per, count_if(label = 'ORG') AS org,
             count_if(label IN ('LOC', 'GPE')) AS loc,
             count_if(label NOT IN ('PER', 'PERSON', 'ORG', 'LOC', 'GPE')) AS misc
      FROM mentions GROUP BY article_id) USING (article_id)
    """,
    "articles",
    "mentions",
)

DIMS = range(1, 17)
step(
    "placed",
    "SELECT k.*, v.coords FROM kept k JOIN vectors v USING (model, article_id)",
    "kept",
    "vectors",
)
step(
    "asked",
    "SELECT a.model, a.article_id, a.ta, v.coords FROM at_pub a JOIN vectors v USING (model, article_id)",
    "at_pub",
    "vectors",
)
step(
    "shapes",
    "SELECT model, snapshot_date, topic_id, count(*) AS n, ["
    + ", ".join(f"avg(coords[{i}])" for i in DIMS)
    + "] AS centroid, ["
    + ", ".join(f"var_pop(coords[{i}]) + 1e-8" for i in DIMS)
    + "] AS variance FROM placed WHERE topic_id <> -1 GROUP BY model, snapshot_date, topic_id",
    "placed",
)
step(
    "to_centroids",
    """
    SELECT model, article_id, ds[1] AS d1, ds[2] AS d2, mahal FROM (
      SELECT q.model, q.article_id, list_sort(list(list_distance(q.coords, s.centroid))) AS ds,
        min(CASE WHEN s.n >= 5 THEN list_sum(list_transform(range(1, 17),
          lambda i: (q.coords[i] - s.centroid[i]) * (q.coords[i] - s.centroid[i]) / s.variance[i])) END) AS mahal
      FROM asked q JOIN shapes s ON s.model = q.model AND s.snapshot_date = q.ta GROUP BY q.model, q.article_id)
    """,
    "asked",
    "shapes",
)
step(
    "near",
    """
    SELECT q.model, q.article_id, list_distance(q.coords, h.coords) AS d, h.is_outlier
    FROM asked q JOIN placed h ON h.model = q.model AND h.snapshot_date = q.ta
    """,
    "asked",
    "placed",
)
step(
    "knn",
    """
    SELECT model, article_id, avg(d) AS knn_mean, stddev_pop(d) AS knn_std FROM (
      SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY model, article_id ORDER BY d) <= 20)
    GROUP BY model, article_id
    """,
    "near",
)
step(
    "proto",
    """
    SELECT model, article_id, avg(d) AS proto FROM (
      SELECT * FROM near WHERE is_outlier QUALIFY row_number() OVER (PARTITION BY model, article_id ORDER BY d) <= 10)
    GROUP BY model, article_id
    """,
    "near",
)
step(
    "geo",
    """
    SELECT a.model, a.article_id, round(d1, 6) AS d1_nearest_centroid, round(d2, 6) AS d2_second_centroid,
           round(d2 - d1, 6) AS margin_d2_minus_d1, round(mahal, 6) AS mahal_nearest, round(knn_mean, 6) AS knn_mean_k20,
           round(knn_std, 6) AS knn_std_k20, round(proto, 6) AS outlier_proto_mean_dist,
           s.outlier_score, (coalesce(o.n, 0) > 0)::INT::DOUBLE AS has_recent_outliers, coalesce(o.n, 0)::DOUBLE AS n_recent_outliers
    FROM asked a JOIN kept s ON s.model = a.model AND s.article_id = a.article_id AND s.snapshot_date = a.ta
    LEFT JOIN to_centroids c ON c.model = a.model AND c.article_id = a.article_id
    LEFT JOIN knn ON knn.model = a.model AND knn.article_id = a.article_id
    LEFT JOIN proto p ON p.model = a.model AND p.article_id = a.article_id
    LEFT JOIN (SELECT model, snapshot_date, count(*) AS n FROM kept WHERE is_outlier GROUP BY ALL) o
      ON o.model = a.model AND o.snapshot_date = a.ta
    """,
    "asked",
    "kept",
    "to_centroids",
    "knn",
    "proto",
)
RANKED = [
    "d1_nearest_centroid",
    "d2_second_centroid",
    "margin_d2_minus_d1",
    "mahal_nearest",
    "knn_mean_k20",
    "knn_std_k20",
    "outlier_proto_mean_dist",
]
step(
    "geo_pct",
    "SELECT model, article_id, outlier_score, has_recent_outliers, n_recent_outliers, "
    + ", ".join(
        f"""CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY model ORDER BY {c} NULLS LAST)
        + (count(*) OVER (PARTITION BY model, {c}) - 1) / 2.0::DOUBLE) / (count({c}) OVER (PARTITION BY model) + 1) END AS {c}_pct"""
        for c in RANKED
    )
    + " FROM geo",
    "geo",
)

step(
    "cuts",
    """
    SELECT article_id, CASE WHEN pub = date_trunc('day', pub) THEN pub + INTERVAL 1 DAY ELSE pub END AS cut FROM articles
    """,
    "articles",
)
step(
    "cuts_tod",
    """
    SELECT article_id, CASE WHEN pub_tod = date_trunc('day', pub_tod) THEN pub_tod + INTERVAL 1 DAY ELSE pub_tod END AS cut
    FROM articles
    """,
    "articles",
)
step(
    "seen",
    "SELECT s.*, c.cut FROM shares s JOIN cuts_tod c USING (article_id) WHERE s.created_at < c.cut",
    "shares",
    "cuts_tod",
)
step(
    "firsts",
    "SELECT author_id, article_id, min(created_at) AS first FROM shares GROUP BY author_id, article_id",
    "shares",
)
step(
    "weights",
    """
    SELECT t.cut, x.article_id AS a, y.article_id AS b, count(*) AS w
    FROM firsts x JOIN firsts y ON x.author_id = y.author_id AND x.article_id < y.article_id
    JOIN (SELECT DISTINCT cut FROM cuts) t ON greatest(x.first, y.first) < t.cut
    GROUP BY t.cut, x.article_id, y.article_id
    """,
    "firsts",
    "cuts",
)
step(
    "links",
    "SELECT cut, a, b, w FROM weights UNION ALL SELECT cut, b, a, w FROM weights",
    "weights",
)
step(
    "ego",
    "SELECT c.article_id, c.cut, l.b AS neighbour, l.w AS weight FROM cuts c JOIN links l ON l.a = c.article_id AND l.cut = c.cut",
    "cuts",
    "links",
)
step(
    "clustering",
    """
    SELECT e.article_id, CASE WHEN count(DISTINCT e.neighbour) < 2 THEN 0 ELSE
             coalesce(any_value(t.s), 0) / any_value(m.mw) / (count(DISTINCT e.neighbour) * (count(DISTINCT e.neighbour) - 1)) END AS cc
    FROM ego e JOIN (SELECT cut, max(w) AS mw FROM weights GROUP BY cut) m USING (cut)
    LEFT JOIN (SELECT x.article_id, sum(cbrt((x.weight * y.weight * l.w)::DOUBLE)) AS s
               FROM ego x JOIN ego y ON x.article_id = y.article_id AND x.neighbour <> y.neighbour
               JOIN links l ON l.cut = x.cut AND l.a = x.neighbour AND l.b = y.neighbour
               GROUP BY x.article_id) t ON t.article_id = e.article_id
    GROUP BY e.article_id
    """,
    "ego",
    "weights",
    "links",
)
step(
    "soc",
    """
    SELECT article_id, count(DISTINCT author_id)::DOUBLE AS users, median(followers_count) AS f, median(tweet_count) AS t,
           median(listed_count) AS l
    FROM shares s JOIN cuts c USING (article_id) WHERE s.created_at < c.cut GROUP BY article_id
    """,
    "shares",
    "cuts",
)

from harbinger.plans.inputs import SETTINGS  # noqa: E402

step(
    "predictions",
    "SELECT doc_id, ablation, CAST(doc_id % 5 + 1 AS INT) AS fold, quality::DOUBLE AS y, "
    "((doc_id * 53 + i * (doc_id % 5 + 2) * 7) % 100) / 100.0::DOUBLE AS p FROM labels, (VALUES "
    + ", ".join(f"({i}, '{n}')" for i, n in enumerate(SETTINGS))
    + ") AS s(i, ablation)",
)
step(
    "fold_scores",
    """
    SELECT ablation, fold, coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1,
           coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS pr, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS rc
    FROM (SELECT ablation, fold, count_if(y = 1 AND p >= 0.5) AS tp, count_if(y = 0 AND p >= 0.5) AS fp,
                 count_if(y = 1 AND p < 0.5) AS fn FROM predictions GROUP BY ablation, fold)
    """,
    "predictions",
)
COMPARED = [
    ("all_features", "no_geom"), ("all_features", "only_geom"), ("all_features", "no_social"),
    ("all_features", "no_text"), ("only_geom", "only_text"), ("only_geom", "only_social"),
]
step(
    "compared",
    """
    SELECT metric, a.ablation AS reference, b.ablation AS comparison, a.fold, a.score AS ref, b.score AS comp
    FROM (UNPIVOT fold_scores ON f1, pr, rc INTO NAME metric VALUE score) a
    JOIN (UNPIVOT fold_scores ON f1, pr, rc INTO NAME metric VALUE score) b USING (metric, fold)
    WHERE (a.ablation, b.ablation) IN ("""
    + ", ".join(f"('{a}', '{b}')" for a, b in COMPARED)
    + ")",
    "fold_scores",
)
step(
    "tests",
    """
    SELECT *, CASE WHEN sd = 0 THEN CASE WHEN md = 0 THEN NULL ELSE 0 END ELSE
             greatest(1 - 2 * (0.375 * u * (1 - u * u / 12)), 0) END AS p
    FROM (SELECT *, abs(t) / sqrt(1 + t * t / 4) AS u FROM (
      SELECT *, CASE WHEN sd > 0 THEN md / (sd / sqrt(n)) END AS t FROM (
        SELECT CASE metric WHEN 'f1' THEN 'F1' WHEN 'pr' THEN 'Precision' ELSE 'Recall' END AS metric, reference, comparison,
               count(*) AS n, avg(ref) AS mr, avg(comp) AS mc, avg(ref - comp) AS md,
               CASE WHEN max(ref - comp) - min(ref - comp) < 1e-12 THEN 0 ELSE stddev_samp(ref - comp) END AS sd,
               string_agg(printf('%.4f', ref - comp), ', ' ORDER BY fold) AS diffs
        FROM compared GROUP BY metric, reference, comparison)))
    """,
    "compared",
)
step(
    "adjusted",
    """
    SELECT *, CASE WHEN p IS NULL THEN NULL ELSE least(min(p * m / r) OVER (ORDER BY r DESC), 1) END AS q
    FROM (SELECT *, count(p) OVER () AS m, row_number() OVER (ORDER BY p NULLS LAST) AS r FROM tests)
    """,
    "tests",
)
step(
    "dated",
    """
    SELECT doc_id, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id * 13 % 70 AS INT)) AS ta, quality AS y, lang AS sub,
           ((doc_id * 53) % 100) / 100.0::DOUBLE AS p FROM documents JOIN labels USING (doc_id)
    """,
)
step(
    "chain_origins",
    """
    SELECT w, m, unnest(CASE WHEN lo + to_days(7 * m) <= hi - to_days(w) THEN
        generate_series(lo + to_days(7 * m), hi - to_days(w), to_days(w)) ELSE [] END) AS origin
    FROM (SELECT min(ta) AS lo, max(ta) AS hi FROM dated), (VALUES (5, 2), (7, 2), (14, 2), (21, 2), (7, 12)) AS g(w, m)
    """,
    "dated",
)
step(
    "chain_counts",
    """
    SELECT w, m, origin, CAST(count_if(ta <= origin) AS BIGINT) AS n_train, sum(CASE WHEN ta <= origin THEN y ELSE 0 END) AS pos_train,
           CAST(count_if(ta > origin AND ta <= origin + to_days(w)) AS BIGINT) AS n_test,
           sum(CASE WHEN ta > origin AND ta <= origin + to_days(w) THEN y ELSE 0 END) AS pos_test
    FROM chain_origins, dated GROUP BY w, m, origin
    """,
    "chain_origins",
    "dated",
)


step(
    "attributions",
    """
    SELECT CAST(doc_id AS VARCHAR) AS article_url, feature, v AS feature_value, ((doc_id * w + 11) % 97 - 48) / 100.0::DOUBLE AS shap_value,
           quality AS y, ((doc_id * 53) % 100) / 100.0::DOUBLE AS pred_proba
    FROM (SELECT doc_id, quality, unnest(['n_chars', 'id_mod', 'constant']) AS feature,
                 unnest([n_chars::DOUBLE, (doc_id % 10)::DOUBLE, 1.0::DOUBLE]) AS v, unnest([29, 31, 37]) AS w
          FROM documents JOIN labels USING (doc_id))
    """,
)
step(
    "attribution_ranks",
    """
    SELECT *, rank() OVER (PARTITION BY feature ORDER BY feature_value) + (count(*) OVER (PARTITION BY feature, feature_value) - 1) / 2.0::DOUBLE AS rx,
           rank() OVER (PARTITION BY feature ORDER BY shap_value) + (count(*) OVER (PARTITION BY feature, shap_value) - 1) / 2.0::DOUBLE AS rs
    FROM attributions
    """,
    "attributions",
)
