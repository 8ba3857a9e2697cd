"""Features of candidate pairs from the normalised fields of both records; null where a field is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordweave.functions import strings as S
from recordweave.functions import text as X
from recordweave.operators.context import add_context
from recordweave.operators.tfidf import char_terms, term_counts, vocabulary, weights, word_terms
from recordweave.runtime import by_key, cut, parallelism

KEY = ["s1", "src", "r"]
FIELDS = ["name", "variants", "core", "addr", "postal", "nums", "phon", "country"]
NAME = (
    "name_tfidf name_word_tfidf name_ratio name_token_sort name_token_set name_partial name_jw name_wjacc name_nospace_ratio name_nospace_partial fullname_token_set name_phon_ratio name_phon_token_set name_variant_best dba_either "
    "name_s1_cov name_s1_miss_idf name_s1_n_miss name_rec_cov name_rec_miss_idf name_rec_n_miss name_first_tok_eq name_len_diff name_len_ratio"
).split()
ADDRESS = "addr_tfidf addr_word_tfidf addr_token_set addr_token_sort addr_partial addr_wjacc".split()
NUMBERS = "num_jacc num_any num_contained num_longest_eq num_longest_in num_best_ratio num_min_reldiff num_prefix".split()
FLAGS = "postal_eq is_s3 same_country name_missing addr_missing_l addr_missing_r postal_missing nums_missing addr_ntok_l addr_ntok_r".split()
BASE = "base_name base_addr base ctx_rank_s1 ctx_gap_s1 ctx_rank_rec ctx_gap_rec ctx_n_rec n_cand_s1".split()
PASSES = [f"{x}_{p}" for x in ("rank", "sim") for p in ("na", "c4", "ph", "nm", "rev")]
STAGE1 = [*NAME, *ADDRESS, *NUMBERS, *FLAGS, *BASE, *PASSES]

L, R = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))


def both(field: str, value: Column) -> Column:
    """value; null where the field is empty on either side."""
    return F.when((L(field) != "") & (R(field) != ""), value)


def text_maps(rec: DataFrame) -> DataFrame:
    """(src, id, name_char, name_word, name_idf, addr_char, addr_word, addr_idf): maps from term to weight, for all records.

    _char: three letters within words, in at least two records, of length 1 with a dampened count; _word: words, of length 1;
    _idf: the words' inverse document frequencies. Every word counts, as pairs are given and no postings meet.
    """
    texts = {"name_char": char_terms(F.col("core"), 3), "name_word": word_terms(F.col("core")), "addr_char": char_terms(F.col("addr"), 3), "addr_word": word_terms(F.col("addr"))}
    each = rec.select(F.struct("src", "id").alias("key"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("terms")) for k, t in texts.items()])).alias("x")).select("key", "x.*")
    c = cut(term_counts(each.withColumn("key", F.struct("key", "kind")), "key", F.col("terms")).withColumn("kind", F.col("key.kind")))
    n = rec.count()
    sizes = rec.sparkSession.createDataFrame([(k, n) for k in texts], "kind string, n long")
    v = vocabulary(c, sizes, 1, 1.0, ["kind"]).filter((F.col("df") >= 2) | F.col("kind").endswith("word"))
    w = weights(c, v, "key", F.col("kind").endswith("char"), ["kind"])
    of = lambda kind, value: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("term", value))))
    maps = [of(k, "w").alias(k) for k in texts] + [of(f"{k}_word", "idf").alias(f"{k}_idf") for k in ("name", "addr")]
    return w.select("key.key", "kind", "term", "w", "idf").groupBy("key").agg(*maps).select("key.*", *texts, "name_idf", "addr_idf")


MAPS = ["name_char", "name_word", "name_idf", "addr_char", "addr_word", "addr_idf"]


def joined(pairs: DataFrame, rec: DataFrame, fields: list[str]) -> DataFrame:
    """pairs (s1, src, r and others) with fields of both records as l_ and r_ columns.

    In as many tasks as keep every core busy: pairs are few bytes and much work, and by their bytes they would be put together into few.
    """
    left = rec.filter("src = 1").select(F.col("id").alias("s1"), *[F.col(c).alias(f"l_{c}") for c in fields])
    right = rec.filter("src != 1").select("src", F.col("id").alias("r"), *[F.col(c).alias(f"r_{c}") for c in fields])
    return pairs.join(by_key(left), "s1").repartition(parallelism(rec.sparkSession), "src", "r").join(by_key(right), ["src", "r"])


def cosines(j: DataFrame) -> dict[str, Column]:
    """The pair's own TF-IDF cosines and weighted Jaccard similarities, from the maps of both sides."""
    dot = lambda m: S.sparse_dot(L(m), R(m))
    name, addr = dot("name_char"), dot("addr_char")
    return {
        "base_name": name, "base_addr": both("addr", addr), "name_tfidf": both("core", name), "name_word_tfidf": both("core", dot("name_word")), "name_wjacc": both("core", S.weighted_jaccard(L("name_idf"), R("name_idf"))),
        "addr_tfidf": both("addr", addr), "addr_word_tfidf": both("addr", dot("addr_word")), "addr_wjacc": both("addr", S.weighted_jaccard(L("addr_idf"), R("addr_idf"))),
    }


def ratios() -> dict[str, Column]:
    """The edit and token ratios: structs of one Arrow pass each, taken apart by name."""
    squeezed = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    n = S.score(["indel_ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio", "jaro_winkler"], L("core"), R("core"))
    s = S.score(["indel_ratio", "partial_ratio"], squeezed(L("core")), squeezed(R("core")))
    p = S.score(["indel_ratio", "token_set_ratio"], L("phon"), R("phon"))
    a = S.score(["token_set_ratio", "token_sort_ratio", "partial_ratio"], L("addr"), R("addr"))
    return {"_n": n, "_s": s, "_p": p, "_a": a, "_f": S.score(["token_set_ratio"], L("name"), R("name")), "_v": S.best_score("token_set_ratio", F.split(L("variants"), r"\|"), F.split(R("variants"), r"\|"))}


def pair_features(pairs: DataFrame, rec: DataFrame) -> DataFrame:
    """pairs (s1, src, r and others) with the features of NAME, ADDRESS, NUMBERS and FLAGS, and base_name, base_addr and base.

    rec has src, id and FIELDS. Weights are dropped before the Arrow passes, which see each distinct pair of strings of a
    batch once.
    """
    maps = rec.join(by_key(text_maps(rec)), ["src", "id"], "left").withColumns({m: F.coalesce(m, F.create_map().cast("map<string,double>")) for m in MAPS})
    j = joined(pairs, maps, [*FIELDS, *MAPS])
    kept = [c for c in j.columns if c not in {f"{x}_{m}" for x in "lr" for m in MAPS if m != "name_idf"}]
    j = j.select(*kept, *[c.alias(n) for n, c in cosines(j).items()])
    words = lambda c: X.tokens(c)
    j = j.withColumns({"_lt": words(L("core")), "_rt": words(R("core")), "_ln": F.filter(F.split("l_nums", " "), lambda x: x != ""), "_rn": F.filter(F.split("r_nums", " "), lambda x: x != "")})
    j = j.withColumns({**ratios(), "_lf": S.near_tokens(F.col("_lt"), F.col("_rt")), "_rf": S.near_tokens(F.col("_rt"), F.col("_lt")), "_h": S.number_features(F.col("_ln"), F.col("_rn"))})
    ln, rn = F.col("_ln"), F.col("_rn")
    numbered = lambda v: F.when((F.size(ln) > 0) & (F.size(rn) > 0), v)
    first = lambda t: F.coalesce(F.try_element_at(t, F.lit(1)), F.lit(""))
    parted = L("variants").contains("|") | R("variants").contains("|")
    num = lambda c: c.cast("double")
    cov = {f"name_{s}_{n}": both("core", c) for s, t, f, m in (("s1", "_lt", "_lf", "l_name_idf"), ("rec", "_rt", "_rf", "r_name_idf")) for n, c in zip(("cov", "miss_idf", "n_miss"), S.covered(F.col(t), F.col(f), F.col(m)), strict=True)}
    out = {
        "name_ratio": both("core", F.col("_n.indel_ratio")), "name_token_sort": both("core", F.col("_n.token_sort_ratio")), "name_token_set": both("core", F.col("_n.token_set_ratio")), "name_partial": both("core", F.col("_n.partial_ratio")), "name_jw": both("core", F.col("_n.jaro_winkler")),
        "name_nospace_ratio": both("core", F.col("_s.indel_ratio")), "name_nospace_partial": both("core", F.col("_s.partial_ratio")), "fullname_token_set": F.col("_f.token_set_ratio"), "name_phon_ratio": both("core", F.col("_p.indel_ratio")), "name_phon_token_set": both("core", F.col("_p.token_set_ratio")),
        "name_variant_best": both("core", F.when(parted, F.col("_v")).otherwise(F.col("_n.token_set_ratio"))), "dba_either": num(parted), **cov, "name_first_tok_eq": both("core", num(first(F.col("_lt")) == first(F.col("_rt")))),
        "name_len_diff": num(F.abs(F.length("l_core") - F.length("r_core"))), "name_len_ratio": S.length_ratio(L("core"), R("core")),
        "addr_token_set": both("addr", F.col("_a.token_set_ratio")), "addr_token_sort": both("addr", F.col("_a.token_sort_ratio")), "addr_partial": both("addr", F.col("_a.partial_ratio")),
        "num_jacc": S.set_jaccard(ln, rn), "num_any": numbered(num(F.arrays_overlap(ln, rn))), "num_contained": S.set_contained(ln, rn), **{f"num_{x}": F.col(f"_h.{x}") for x in ("longest_eq", "longest_in", "best_ratio", "min_reldiff", "prefix")},
        "postal_eq": num(S.known_equal(L("postal"), R("postal"))), "is_s3": num(F.col("src") == 3), "same_country": num(S.known_equal(L("country"), R("country"))), "name_missing": num((L("core") == "") | (R("core") == "")), "addr_missing_l": num(L("addr") == ""), "addr_missing_r": num(R("addr") == ""),
        "postal_missing": num((L("postal") == "") | (R("postal") == "")), "nums_missing": num((F.size(ln) == 0) | (F.size(rn) == 0)), "addr_ntok_l": num(F.size(X.tokens(L("addr")))), "addr_ntok_r": num(F.size(X.tokens(R("addr")))),
        "base": F.when(F.col("base_addr").isNull(), F.col("base_name")).otherwise(0.5 * F.col("base_name") + 0.5 * F.col("base_addr")),
    }
    made = {"name_tfidf", "name_word_tfidf", "name_wjacc", "addr_tfidf", "addr_word_tfidf", "addr_wjacc", "base_name", "base_addr"}
    return j.select(*pairs.columns, *made, *[c.alias(n) for n, c in out.items()])


def stage1_features(candidates: DataFrame, rec: DataFrame) -> DataFrame:
    """candidates (s1, src, r and the rank_ and sim_ columns of PASSES, and others) with all of STAGE1: pair features, then their base score among competitors."""
    f = cut(pair_features(candidates, rec))
    return add_context(f, "base", ["s1", "src"], ["src", "r"]).select(*candidates.columns, *[c for c in STAGE1 if c not in candidates.columns])
