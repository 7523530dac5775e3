"""Skill corpus queries: requirement text, gazetteer, similarity, records, statistics, backfill."""

from pyspark.sql import functions as F

from vacantia.config import SkillConfig
from vacantia.functions import scoring as sc
from vacantia.functions import text as tx
from vacantia.operators import similarity as sim
from vacantia.operators import skills as k
from vacantia.plans.bindings import MENTIONS_SQL, NORMALIZED_ALL_SQL, NORMALIZED_SQL, USER_SKILLS_SQL, bind, duck
from vacantia.sources import readers as rd
from vacantia.util import r6, r6e, read_table, shared_dir

from .merge import UNIFIED, unified
from .merge import postings as merged_postings

M = f"ment AS ({duck(MENTIONS_SQL)})"
N = f"norm AS ({duck(NORMALIZED_SQL)})"
#: Taxonomy of the extraction chain: part names with an "o", their brands and types, suppliers. Other part names have no label.
LABELS = """labels_ AS (SELECT name, CAST(min(id) AS INT) AS skill_id FROM (SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name LIKE '%o%'
  UNION ALL SELECT p_partkey, p_brand FROM part UNION ALL SELECT p_partkey, p_type FROM part UNION ALL SELECT s_suppkey, s_name FROM supplier) GROUP BY 1)"""


def best_sql(phrases: str) -> str:
    """Best label of each phrase (a SELECT of ``phrase``) by the cosine of letter triples."""
    return f"""{LABELS}, ph AS (SELECT DISTINCT trim(phrase) AS phrase FROM ({phrases}) WHERE trim(phrase) <> ''),
  tv AS (SELECT name, h, count(*) AS c FROM (SELECT name, (ascii(substr(t, i, 1)) * 961 + ascii(substr(t, i + 1, 1)) * 31 + ascii(substr(t, i + 2, 1))) % 256 AS h
    FROM (SELECT name, ' ' || lower(trim(name)) || ' ' AS t FROM (SELECT phrase AS name FROM ph UNION SELECT name FROM labels_)), (SELECT CAST(unnest(range(1, 100)) AS INT) AS i) WHERE i <= length(t) - 2) GROUP BY 1, 2),
  nv AS (SELECT name, sqrt(sum(c * c)) AS l FROM tv GROUP BY 1),
  sims AS (SELECT a.name AS phrase, b.name, sum(a.c * b.c) / (any_value(x.l) * any_value(y.l)) AS s FROM ph JOIN tv a ON a.name = phrase JOIN tv b ON b.h = a.h JOIN labels_ k ON k.name = b.name
    JOIN nv x ON x.name = a.name JOIN nv y ON y.name = b.name GROUP BY 1, 2),
  near AS (SELECT phrase, name AS normalized, round(s + 1e-9, 6) AS similarity, 'embedding' AS method, skill_id FROM sims JOIN labels_ USING (name)
    QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY round(s, 9) DESC, name) = 1 AND s >= 0.68),
  {fuzzy_sql()},
  best AS (SELECT * FROM near UNION ALL SELECT * FROM alike)"""


def fuzzy_sql() -> str:
    """Token-sort matches of phrases without a near label; the longest common subsequence row by row."""
    tokens = "array_to_string(list_sort(list_filter(string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '')), ' ')"
    return f"""open_ AS (SELECT phrase, {tokens.format(c='phrase')} AS a FROM ph WHERE phrase NOT IN (SELECT phrase FROM near)),
  lcs_ AS (SELECT phrase, name, a, {tokens.format(c='name')} AS b, 0 AS i, list_transform(range(length({tokens.format(c='name')})), lambda x: 0) AS r FROM open_ CROSS JOIN labels_
    UNION ALL SELECT phrase, name, a, b, i + 1, list_transform(range(1, length(b) + 1), lambda j: greatest(r[j], coalesce(list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN b[k] = a[i + 1] THEN coalesce(r[k - 1], 0) + 1 ELSE 0 END)), 0)))
    FROM lcs_ WHERE i < length(a)),
  alike AS (SELECT phrase, name AS normalized, ratio / 100 AS similarity, 'fuzzy' AS method, skill_id FROM (SELECT phrase, name, round_even(200.0::DOUBLE * r[length(b)] / (length(a) + length(b)), 0) AS ratio FROM lcs_ WHERE i = length(a))
    JOIN labels_ USING (name) LEFT JOIN sims USING (phrase, name) WHERE ratio >= 78 QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY ratio DESC, round(coalesce(s, 0), 9) DESC, name) = 1)"""
VOCAB_SQL = """SELECT DISTINCT label FROM (
  SELECT unnest(regexp_extract_all(text, '[A-Za-z]{8,}')) AS label FROM benchmark
  UNION ALL SELECT lower(w[i]) || ' ' || lower(w[i + 1]) FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark), (SELECT CAST(unnest(range(1, 200)) AS INT) AS i)
    WHERE i < len(w) AND length(w[i]) >= 6 AND length(w[i + 1]) >= 6) WHERE label IS NOT NULL"""


def ment(s, d):
    return bind(s, d, MENTIONS_SQL)


def norm(s, d):
    return bind(s, d, NORMALIZED_SQL)


def vocabulary(s, d):
    b = read_table(s, d, "benchmark")
    words = b.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("label"))
    # Labels of two words: all neighbours of six letters or more, wherever they stand.
    w = b.select(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).select("w", F.posexplode("w").alias("i", "a")).withColumn("b", F.get("w", F.col("i") + 1))
    pairs = w.filter((F.length("a") >= 6) & (F.length("b") >= 6)).select(F.concat_ws(" ", F.lower("a"), F.lower("b")).alias("label"))
    return words.unionByName(pairs).distinct()


def gaz(s, d):
    hits = k.gazetteer(read_table(s, d, "documents"), vocabulary(s, d), key="doc_id")
    return hits.select("doc_id", "label", "score", "method")


def sections_of(s, d):
    docs = read_table(s, d, "documents")
    return docs.select("doc_id", F.char_length(k.extraction_text("text")).alias("n"), F.char_length(k.requirement_text("text")).alias("n_req"))


PARTED_SQL = "SELECT p_partkey, p_partkey % 4 AS form, p_name, p_brand, p_type FROM {part}"


def titled_sections(s, d):
    """Descriptions written from the parts by turns: titled sections, bullets, a line with a cue, none of these."""
    t = F.lit
    p = bind(s, d, PARTED_SQL)
    text = (F.when(F.col("form") == 0, F.concat(t("About us:\nWe must sell "), "p_name", t("\n\nWhat you will need:\nSkill in "), "p_type", t(", 2 years.\nand "), "p_brand", t("\nBenefits\nLunch, as required\nEducation\nSome "), "p_name", t(", 1st class.")))
            .when(F.col("form") == 1, F.concat(t("We sell "), "p_name", t(".\n- knows "), "p_type", t("\n2) likes "), "p_brand", t("\n* our benefits\nThe end, and that is all of it.")))
            .when(F.col("form") == 2, F.concat(t("We sell "), "p_name", t(".\nYou should like "), "p_brand", t(". Really.\nNo more of that, 1 or 2.")))
            .otherwise(F.concat(t("We sell "), "p_name", t(" and "), "p_brand", t("."))))
    return p.select("p_partkey", k.requirement_text(text).alias("needs"), k.extraction_text(text).alias("read"))


def scored_words(s, d):
    """Education, seniority and size scores of texts with every kind of word."""
    p = bind(s, d, "SELECT p_partkey, p_name, p_partkey % 7 AS e, p_partkey % 5 AS s, p_partkey % 4 AS z FROM {part}")
    pick = lambda c, words: F.get(F.array(*[F.lit(w) for w in words]), F.col(c).cast("int"))
    edu, lead, size = pick("e", ("PhD in", "MSc of", "Bachelor of", "a diploma in", "school for", "", None)), pick("s", ("Junior ", "Senior ", "Head of ", "", "Graduate ")), pick("z", ("Startup for ", "201-500 in ", "Multinational ", "firm of "))
    return p.select("p_partkey", sc.education_score(F.concat_ws(" ", edu, F.when(F.col("e") < 5, F.col("p_name")))).alias("education"), sc.title_seniority(F.concat(lead, F.col("p_name"))).alias("seniority"),
                    sc.company_size_score(F.concat(size, F.lit("makers"))).alias("size"))


def phrases(s, d):
    return unified(s, d).select("job_id", F.posexplode(tx.split_phrases("requirements")).alias("pos", "phrase"))


def candidates(s, d):
    return k.candidate_phrases(merged_postings(s, d)).select("job_id", "phrase")


def labels(s, d):
    m = bind(s, d, "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'MISC' WHEN 'LARGE' THEN 'ORG' WHEN 'PROMO' THEN 'PER' ELSE p_type END AS label FROM {part}")
    return k.map_labels(m).select("p_partkey", "skill_type")


def vectors(s, d):
    return read_table(s, d, "embeddings")


def near(s, d, top=5):
    v = vectors(s, d)
    return sim.nearest(v.withColumnRenamed("vec_id", "phrase"), v.withColumnRenamed("vec_id", "label_id"), top, floor=None)


def near_matches(s, d):
    got = near(s, d, 10).filter("phrase <> label_id")
    return sim.embedding_matches(got.withColumn("rank", F.col("rank") - 1), SkillConfig(embedding_threshold=0.35), 5).select(
        "phrase", "label_id", r6e("similarity").alias("similarity"))


def near_by_index(s, d):
    """Every twentieth vector asks the inverted file over all of them."""
    v = vectors(s, d)
    return sim.nearest_indexed(v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "phrase"), v.withColumnRenamed("vec_id", "label_id"), 10)


def index_recall(s, d):
    v = vectors(s, d)
    exact = sim.nearest(v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "phrase"), v.withColumnRenamed("vec_id", "label_id"), 10)
    return sim.recall(near_by_index(s, d), exact)


def normalized_phrases(s, d):
    v = vectors(s, d)
    lib = v.select(F.col("vec_id").alias("label_id"), F.col("vec_id").alias("skill_id"), F.concat_ws(" ", F.lit("skill group"), "label", F.lit("item"), "vec_id").alias("name"), "embedding")
    ph = v.select(F.concat_ws(" ", "vec_id", F.lit("item of"), "label", F.lit("group")).alias("phrase"), "embedding")
    out = sim.normalize_phrases(ph, lib, SkillConfig(embedding_threshold=1.1, fuzzy_threshold=78), top_k=2)
    return out.select("phrase", "skill_id", "name", r6("similarity").alias("similarity"), "method", "rank")


def token_ratio(s, d):
    p = read_table(s, d, "part")
    return p.select("p_partkey", sim.token_sort_ratio(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws("-", "p_type", "p_name", "p_brand")).alias("ratio"),
                    sim.token_sort_ratio(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws("  ", "p_type", F.upper("p_name"))).alias("same"))


def distinct_m(s, d):
    m = ment(s, d).withColumn("label", F.upper("skill_text"))
    return k.distinct_mentions(m, ["job_id"], "label", "confidence_score", "created_at").select(
        "job_id", "skill_text", F.col("confidence_score").cast("double").alias("confidence"))


def merged_results(s, d):
    n = norm(s, d).select(F.col("raw_skill_text").alias("phrase"), F.col("esco_skill_id").alias("skill_id"), F.col("normalized_skill_name").alias("name"),
                          F.col("similarity_score").cast("double").alias("similarity"), F.col("normalization_method").alias("method"))
    return sim.merge_matches(n, 3).select("phrase", "skill_id", "name", "similarity", "rank")


TAX_A = "SELECT CAST(p_partkey AS INT) AS id, 'uri:' || CAST(p_partkey AS STRING) AS skill_uri, p_type AS skill_type, p_name AS preferred_label, p_brand AS b, p_type AS t FROM {part}"


def lib(s, d):
    a = bind(s, d, TAX_A).withColumn("alternative_labels", F.array("b", F.concat(F.lit(" "), "t"), F.lit("  ")))
    b = bind(s, d, "SELECT CAST(s_suppkey AS INT) AS id, s_name AS element_id, s_name AS element_name, 'Knowledge' AS category FROM {supplier}")
    return k.library(a, b)


def taxonomy_csv(s, d):
    path = shared_dir(s, "taxonomy-a")
    bind(s, d, """SELECT 'uri:' || CAST(p_partkey AS STRING) AS conceptUri, 'S' AS conceptType, p_name AS preferredLabel,
        p_brand || chr(10) || ' ' || p_type || chr(10) AS altLabels, 'says "' || p_name || '", ok' AS description, p_type AS skillType FROM {part}""").write.option(
        "header", True).option("escape", '"').csv(path)
    return rd.read_taxonomy_a(s, path).select("skill_uri", "preferred_label", F.array_join("alternative_labels", "|").alias("alts"), "description", "skill_code")


def taxonomy_tsv(s, d):
    files = {}
    for cat, sql in (("Skills", "SELECT CAST(p_partkey AS STRING) AS `Element ID`, p_name AS `Element Name`, CAST(p_retailprice AS STRING) AS `Data Value` FROM {part}"),
                     ("Knowledge", "SELECT CAST(s_suppkey AS STRING) AS `Element ID`, s_name AS `Element Name`, 'n/a' AS `Data Value` FROM {supplier}")):
        files[cat] = shared_dir(s, "taxonomy-b")
        bind(s, d, sql).write.option("header", True).option("sep", "\t").csv(files[cat])
    return rd.read_taxonomy_b(s, files).select("element_id", "element_name", "category", r6("data_value").alias("data_value"))


def batch_last(s, d):
    return rd.last_per_key(read_table(s, d, "part"), "p_name", "p_partkey").select("p_name", "p_partkey", "p_brand")


def batch_longest(s, d):
    p = read_table(s, d, "part").select(F.col("p_name").alias("element_id"), F.concat_ws("", "p_brand", "p_type").alias("description"), F.col("p_partkey").alias("seq"))
    return rd.longest_description(p).select("element_id", "description", "seq")


def chain_library(s, d):
    return lib(s, d).filter("source = 'B' OR is_alternative OR name LIKE '%o%'")


def best_of(names, s, d, column):
    best = sim.best_of_names(names, chain_library(s, d), column=column)
    return best.withColumn("similarity", r6e("similarity"))


def chain(s, d):
    """Extraction over the merged postings: mentions, and their normalised records."""
    return k.extraction_chain(merged_postings(s, d), chain_library(s, d), sim.best_of_names)


def records(cfg):
    def run(s, d):
        out = k.skill_records(ment(s, d), best_of(ment(s, d), s, d, "skill_text"), cfg)
        return out.groupBy("raw", "skill_type", "normalized", "similarity", "normalization_method", "skill_id").agg(F.count(F.lit(1)).alias("n"))
    return run


def user_records(s, d):
    own = bind(s, d, USER_SKILLS_SQL)
    return k.user_skill_records(own, best_of(own, s, d, "name"))


def chain_records(s, d):
    found, rec = chain(s, d)
    return rec.select("job_id", "raw", "normalized", r6e("similarity").alias("similarity"), "normalization_method", "skill_id")


def req_text(s, d):
    found, rec = chain(s, d)
    return k.requirements_text(rec.withColumn("seq", F.col("raw")), found.withColumn("seq", F.col("skill_text")))


def posts(s, d):
    return unified(s, d).select("job_id", "requirements", "description", "full_description")


def norm_of_all(s, d):
    """Normalised names of the postings of both sources."""
    return bind(s, d, NORMALIZED_ALL_SQL)


def late_norm(s, d):
    return norm_of_all(s, d).filter(F.col("similarity_score") >= 0.95)


def routed(s, d):
    return k.route(k.with_normalized_flag(posts(s, d), late_norm(s, d))).select("job_id", "has_normalized", "route")


def fill_empty(s, d):
    texts = req_text(s, d)
    return k.backfill_if_empty(merged_postings(s, d), texts).select("job_id", "requirements")


def fill_all(s, d):
    return k.backfill_always(posts(s, d), k.requirements_json(late_norm(s, d))).select("job_id", "requirements")


def named(s, d):
    ids = posts(s, d).filter(tx.requirements_empty("requirements")).select("job_id")
    return k.skills_of(norm_of_all(s, d), ids).groupBy("job_id", "normalized_skill_name").agg(F.count(F.lit(1)).alias("n"))


def stats_sets(s, d):
    m = ment(s, d).withColumn("similarity_score", F.col("confidence_score"))
    return k.statistics_by_group(m, ["skill_type", "extraction_method"], "skill_text")


def report(s, d):
    return k.mapping_report(norm(s, d)).select("raw_skill_text", "normalized_skill_name", F.col("similarity_score").cast("double").alias("similarity"),
                                               "normalization_method", "frequency", "band")


def canonical(s, d):
    n = norm(s, d).select("job_id", F.col("esco_skill_id").alias("skill_id"), F.col("normalized_skill_name").alias("normalized"))
    return k.canonical_names(n, lib(s, d).filter("source = 'A'")).groupBy("normalized").agg(F.count(F.lit(1)).alias("n"))


W = f"WITH {UNIFIED}"
_PH = r"""CASE WHEN trim(requirements) LIKE '[%' THEN list_filter(from_json(requirements, '["VARCHAR"]'), lambda x: trim(x) <> '')
  ELSE list_filter(list_transform(regexp_split_to_array(trim(coalesce(requirements,'')), '[;\n\r]+'), lambda x: trim(x)), lambda x: x <> '') END"""
_CAND = r"""list_concat(CASE WHEN trim(requirements) LIKE '[%' THEN from_json(requirements, '["VARCHAR"]') ELSE regexp_split_to_array(coalesce(requirements,''), '[,\n;/|]+') END,
  regexp_split_to_array(coalesce(description,''), '[,\n;/|]+'), regexp_split_to_array(title, '[/|,+()\-]'))"""
REC = "SELECT m.skill_text AS raw, m.skill_type, b.normalized, b.similarity, b.method AS normalization_method, b.skill_id, m.job_id FROM ment m JOIN best b ON b.phrase = m.skill_text"
BEST = best_sql(f"SELECT skill_text AS phrase FROM ({duck(MENTIONS_SQL)})")
BEST_OF_USERS = best_sql(f"SELECT name AS phrase FROM ({duck(USER_SKILLS_SQL)})")
#: Mentions of the chain, and their records.
CHAIN = f"""{LABELS.replace('labels_', 'voc_')}, tx AS (SELECT job_id, coalesce(nullif(full_description, ''), nullif(description, '')) AS text FROM postings),
  tok AS (SELECT DISTINCT job_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM tx),
  found AS (SELECT job_id, name AS skill_text, 0.95 AS score, 1 AS seq FROM voc_ JOIN tok ON w = lower(name) WHERE NOT contains(name, ' ') AND NOT contains(name, '#')
    UNION ALL SELECT job_id, name, 0.95, 1 FROM voc_ JOIN tx ON contains(lower(text), lower(name)) AND regexp_matches(' ' || lower(text) || ' ', '\\b' || lower(name) || '\\b') WHERE contains(name, '#')
    UNION ALL SELECT job_id, name, 0.90, 1 FROM voc_ JOIN tx ON contains(lower(text), lower(name)) WHERE contains(name, ' ')
    UNION ALL SELECT job_id, unnest({_PH}), 0.95, 0 FROM postings),
  mentioned AS (SELECT job_id, skill_text FROM found QUALIFY row_number() OVER (PARTITION BY job_id, lower(skill_text) ORDER BY score DESC, seq) = 1),
  {best_sql("SELECT skill_text AS phrase FROM mentioned")},
  rec AS (SELECT job_id, trim(skill_text) AS raw, normalized, similarity, method, skill_id FROM mentioned JOIN best ON phrase = trim(skill_text))"""
POSTS = "ps AS (SELECT job_id, requirements, description, full_description FROM unified)"
NA = f"norm AS ({duck(NORMALIZED_ALL_SQL)})"
LATE = f"{NA}, late AS (SELECT * FROM norm WHERE similarity_score >= 0.95)"
RT = f"""{CHAIN}, a AS (SELECT job_id, string_agg(normalized, '; ' ORDER BY s, normalized) AS t FROM (SELECT job_id, normalized, min(raw) AS s FROM rec GROUP BY 1, 2) GROUP BY 1),
  b AS (SELECT job_id, string_agg(skill_text, '; ' ORDER BY skill_text) AS t FROM mentioned GROUP BY 1),
  rt AS (SELECT b.job_id, coalesce(a.t, b.t) AS requirements_text FROM b LEFT JOIN a USING (job_id))"""
COS = "cs AS (SELECT a.vec_id AS phrase, b.vec_id AS label_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a CROSS JOIN embeddings b)"
QUERIES = {
    "p24_w13_extraction_text": sections_of,
    "p24_w13_titled_sections": titled_sections,
    "p19_word_scores": scored_words,
    "p25_requirement_phrases": phrases,
    "p26_candidate_phrases": candidates,
    "p27_label_types": labels,
    "j09_gazetteer": gaz,
    "a21_distinct_mentions": distinct_m,
    "a22_merge_match_results": merged_results,
    "j07_w06_nearest_labels": lambda s, d: near(s, d).select("phrase", "label_id", r6e("similarity").alias("similarity"), "rank"),
    "j07_matches_above_threshold": near_matches,
    "j07_nearest_by_index": near_by_index,
    "j07_index_recall": index_recall,
    "j08_normalize_phrases_fuzzy": normalized_phrases,
    "c24_token_sort_ratio": token_ratio,
    "u03_taxonomy_library": lambda s, d: lib(s, d).select("id", "name", "is_alternative", "source"),
    "u03_keyword_vocabulary": lambda s, d: k.keywords(lib(s, d)),
    "s05_taxonomy_a_csv": taxonomy_csv,
    "s06_taxonomy_b_tsv": taxonomy_tsv,
    "a19_last_record_per_key": batch_last,
    "a20_longest_description": batch_longest,
    "p28_skill_records": records(SkillConfig()),
    "p28_skill_records_raw_fallback": records(SkillConfig(allow_raw_unmapped=True)),
    "j05_user_skill_records": user_records,
    "p29_requirements_text": req_text,
    "p24_p29_extraction_chain": chain_records,
    "p30_requirements_json": lambda s, d: k.requirements_json(norm(s, d)),
    "j06_f08_f09_route": routed,
    "s16_f06_backfill_if_empty": fill_empty,
    "s17_backfill_always": fill_all,
    "j24_skills_of_postings": named,
    "a08_corpus_statistics": lambda s, d: k.corpus_statistics(ment(s, d), norm(s, d)).withColumn("avg_similarity", r6("avg_similarity")),
    "a08_l04_top_skills": lambda s, d: k.top_skills(norm(s, d), 10),
    "a09_statistics_by_group": stats_sets,
    "a10_mapping_report": report,
    "a11_mentions_per_posting": lambda s, d: k.mention_counts(ment(s, d)),
    "a11_mention_averages": lambda s, d: k.mention_averages(ment(s, d)).select("postings", r6("avg_mentions").alias("avg_mentions"), r6("avg_tools").alias("avg_tools")),
    "t14_canonical_names": canonical,
}
ORACLE = {
    "p24_w13_titled_sections": r"""WITH x AS (SELECT p_partkey, CASE p_partkey % 4
          WHEN 0 THEN 'Skill in ' || p_type || ', 2 years.' || chr(10) || 'and ' || p_brand || chr(10) || 'Some ' || p_name || ', 1st class.'
          WHEN 1 THEN '- knows ' || p_type || chr(10) || '2) likes ' || p_brand
          WHEN 2 THEN 'You should like ' || p_brand || '. Really.' ELSE '' END AS needs, 'We sell ' || p_name || ' and ' || p_brand || '.' AS whole FROM part)
        SELECT p_partkey, needs, CASE WHEN needs = '' THEN whole ELSE needs END AS read FROM x""",
    "p19_word_scores": """SELECT p_partkey, [1.0, 0.8, 0.6, 0.4, 0.5, NULL, NULL][p_partkey % 7 + 1]::DOUBLE AS education, [0.85, 0.45, 0.35, 0.65, 0.85][p_partkey % 5 + 1]::DOUBLE AS seniority,
        [0.75, 0.65, 0.55, 0.6][p_partkey % 4 + 1]::DOUBLE AS size FROM part""",
    "p24_w13_extraction_text": "SELECT doc_id, CAST(length(text) AS INT) AS n, 0 AS n_req FROM documents",
    "p25_requirement_phrases": f"{W}, p AS (SELECT job_id, {_PH} AS ph FROM unified), x AS (SELECT job_id, unnest(ph) AS phrase, unnest(range(len(ph))) AS pos FROM p) SELECT job_id, CAST(pos AS INT) AS pos, phrase FROM x",
    "p26_candidate_phrases": f"""{W}, p AS (SELECT job_id, list_filter(list_transform({_CAND}, lambda x: trim(x)), lambda x: x <> '') AS ph FROM postings),
        x AS (SELECT job_id, unnest(ph) AS phrase, unnest(range(len(ph))) AS pos FROM p) SELECT job_id, phrase FROM x QUALIFY row_number() OVER (PARTITION BY job_id, lower(phrase) ORDER BY pos) = 1""",
    "p27_label_types": "SELECT p_partkey, CASE p_type WHEN 'LARGE' THEN 'TOOL' ELSE 'SKILL' END AS skill_type FROM part WHERE p_type <> 'PROMO'",
    "j09_gazetteer": f"""WITH v AS ({VOCAB_SQL}), tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents)
        SELECT doc_id, label, 0.95::DOUBLE AS score, 'keyword_match_exact' AS method FROM v JOIN tok ON w = lower(label) WHERE NOT contains(label, ' ')
        UNION ALL SELECT doc_id, label, 0.90::DOUBLE, 'keyword_match_substring' FROM v JOIN documents ON contains(lower(text), lower(label)) WHERE contains(label, ' ')""",
    "a21_distinct_mentions": f"WITH {M} SELECT job_id, skill_text, CAST(max(confidence_score) AS DOUBLE) AS confidence FROM ment GROUP BY 1, 2",
    "a22_merge_match_results": f"""WITH {N}, b AS (SELECT raw_skill_text AS phrase, esco_skill_id AS skill_id, normalized_skill_name AS name, CAST(max(similarity_score) AS DOUBLE) AS similarity FROM norm GROUP BY 1, 2, 3)
        SELECT *, CAST(row_number() OVER (PARTITION BY phrase ORDER BY similarity DESC, skill_id, name) AS INT) AS rank FROM b QUALIFY rank <= 3""",
    "j07_w06_nearest_labels": f"WITH {COS} SELECT phrase, label_id, round(similarity + 1e-9, 6) AS similarity, CAST(row_number() OVER (PARTITION BY phrase ORDER BY similarity DESC, label_id) AS INT) AS rank FROM cs QUALIFY rank <= 5",
    "j07_matches_above_threshold": f"WITH {COS}, r AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY similarity DESC, label_id) AS rk FROM cs WHERE phrase <> label_id) SELECT phrase, label_id, round(similarity + 1e-9, 6) AS similarity FROM r WHERE rk <= 5 AND similarity >= 0.35",
    "u03_taxonomy_library": """SELECT CAST(p_partkey AS INT) AS id, p_name AS name, false AS is_alternative, 'A' AS source FROM part UNION ALL SELECT CAST(p_partkey AS INT), p_brand, true, 'A' FROM part
        UNION ALL SELECT CAST(p_partkey AS INT), p_type, true, 'A' FROM part UNION ALL SELECT CAST(s_suppkey AS INT), s_name, false, 'B' FROM supplier""",
    "u03_keyword_vocabulary": "SELECT p_name AS label FROM part UNION SELECT p_brand FROM part UNION SELECT p_type FROM part UNION SELECT s_name FROM supplier",
    "s05_taxonomy_a_csv": "SELECT 'uri:' || CAST(p_partkey AS VARCHAR) AS skill_uri, p_name AS preferred_label, p_brand || '|' || p_type AS alts, 'says \"' || p_name || '\", ok' AS description, '' AS skill_code FROM part",
    "s06_taxonomy_b_tsv": "SELECT CAST(p_partkey AS VARCHAR) AS element_id, p_name AS element_name, 'Skills' AS category, round(p_retailprice, 6) AS data_value FROM part UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, 'Knowledge', 0.0 FROM supplier",
    "a19_last_record_per_key": "SELECT p_name, p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1",
    "a20_longest_description": "SELECT p_name AS element_id, p_brand || p_type AS description, p_partkey AS seq FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY length(p_brand || p_type) DESC, p_partkey) = 1",
    "p28_skill_records": f"WITH {M}, {BEST} SELECT raw, skill_type, normalized, similarity, normalization_method, skill_id, count(*) AS n FROM ({REC}) GROUP BY ALL",
    "p28_skill_records_raw_fallback": f"""WITH {M}, {BEST} SELECT skill_text AS raw, skill_type, coalesce(normalized, skill_text) AS normalized, coalesce(similarity, 0.0) AS similarity, coalesce(method, 'raw_unmapped') AS normalization_method,
        skill_id, count(*) AS n FROM ment LEFT JOIN best ON phrase = skill_text WHERE normalized IS NOT NULL OR length(skill_text) >= 5 GROUP BY ALL""",
    "j05_user_skill_records": f"WITH {BEST_OF_USERS}, us AS ({duck(USER_SKILLS_SQL)}) SELECT user_id, name AS raw, coalesce(normalized, name) AS normalized, coalesce(similarity, 0.0) AS similarity, coalesce(method, 'no_match') AS normalization_method, skill_id FROM us LEFT JOIN best ON phrase = name",
    "p29_requirements_text": f"{W}, {RT} SELECT job_id, requirements_text FROM rt",
    "p24_p29_extraction_chain": f"{W}, {CHAIN} SELECT job_id, raw, normalized, similarity, method AS normalization_method, skill_id FROM rec",
    "p30_requirements_json": f"""WITH {N}, g AS (SELECT job_id, list_sort(list(DISTINCT normalized_skill_name)) AS l FROM norm GROUP BY 1) SELECT job_id, '["' || array_to_string(l, '","') || '"]' AS requirements_json FROM g""",
    "j06_f08_f09_route": f"""{W}, {POSTS}, {LATE}, h AS (SELECT ps.*, job_id IN (SELECT job_id FROM late) AS has_normalized, (requirements IS NULL OR trim(requirements) IN ('', '[]')) AS open FROM ps)
        SELECT job_id, has_normalized, CASE WHEN has_normalized THEN 'backfill_only' WHEN NOT open THEN 'phrases_only' ELSE 'extract' END AS route FROM h WHERE open OR NOT has_normalized""",
    "s16_f06_backfill_if_empty": f"{W}, {RT} SELECT job_id, CASE WHEN requirements IS NULL OR trim(requirements) IN ('', '[]') THEN coalesce(requirements_text, requirements) ELSE requirements END AS requirements FROM postings LEFT JOIN rt USING (job_id)",
    "s17_backfill_always": f"""{W}, {POSTS}, {LATE}, g AS (SELECT job_id, '["' || array_to_string(list_sort(list(DISTINCT normalized_skill_name)), '","') || '"]' AS j FROM late GROUP BY 1) SELECT job_id, coalesce(j, requirements) AS requirements FROM ps LEFT JOIN g USING (job_id)""",
    "j24_skills_of_postings": f"{W}, {POSTS}, {NA} SELECT job_id, normalized_skill_name, count(*) AS n FROM norm WHERE job_id IN (SELECT job_id FROM ps WHERE requirements IS NULL OR trim(requirements) IN ('', '[]')) GROUP BY 1, 2",
    "a08_corpus_statistics": f"""WITH {M}, {N} SELECT (SELECT count(DISTINCT job_id) FROM ment) AS total_jobs, (SELECT count(*) FROM ment) AS total_extracted, (SELECT count(DISTINCT skill_text) FROM ment) AS unique_extracted,
        count(*) AS total_normalized, count(DISTINCT normalized_skill_name) AS unique_normalized, round(avg(similarity_score::DOUBLE), 6) AS avg_similarity FROM norm""",
    "a08_l04_top_skills": f"WITH {N} SELECT normalized_skill_name, count(*) AS n FROM norm GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "a09_statistics_by_group": f"""WITH {M} SELECT 'overall' AS dimension, NULL AS value, count(*) AS n, count(DISTINCT skill_text) AS unique_raw, round(avg(confidence_score::DOUBLE) + 1e-9, 6) AS avg_similarity FROM ment
        UNION ALL SELECT 'skill_type', skill_type, count(*), count(DISTINCT skill_text), round(avg(confidence_score::DOUBLE) + 1e-9, 6) FROM ment GROUP BY 2
        UNION ALL SELECT 'extraction_method', extraction_method, count(*), count(DISTINCT skill_text), round(avg(confidence_score::DOUBLE) + 1e-9, 6) FROM ment GROUP BY 2""",
    "a10_mapping_report": f"""WITH {N} SELECT raw_skill_text, normalized_skill_name, CAST(similarity_score AS DOUBLE) AS similarity, normalization_method, count(*) AS frequency,
        CASE WHEN similarity_score >= 0.9 THEN 'high' WHEN similarity_score >= 0.7 THEN 'medium' ELSE 'low' END AS band FROM norm GROUP BY raw_skill_text, normalized_skill_name, similarity_score, normalization_method
        ORDER BY frequency DESC, raw_skill_text, normalized_skill_name, similarity, normalization_method LIMIT 100""",
    "a11_mentions_per_posting": f"WITH {M} SELECT job_id, skill_type, count(*) AS n FROM ment GROUP BY ROLLUP (job_id, skill_type)",
    "a11_mention_averages": f"WITH {M}, g AS (SELECT job_id, count(*) AS n, count(*) FILTER (skill_type = 'TOOL') AS t FROM ment GROUP BY 1) SELECT count(*) AS postings, round(avg(n), 6) AS avg_mentions, round(avg(t), 6) AS avg_tools FROM g",
    "t14_canonical_names": f"WITH {N} SELECT p_name AS normalized, count(*) AS n FROM norm JOIN part ON p_partkey = esco_skill_id GROUP BY 1",
}
ORACLE = {name: sql.replace("WITH ", "WITH RECURSIVE ", 1) if "lcs_ AS" in sql else sql for name, sql in ORACLE.items()}
