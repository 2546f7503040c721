"""The two readmission feature jobs and the train/evaluate job."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.operators import models, scoring
from tabwright.operators.categorical import encode_categoricals, label_encode, one_hot
from tabwright.operators.profile import bounds_map, numeric_cols, text_cols
from tabwright.operators.recode import (
    AGE_LEVELS, binary_flags, drop_cols, encode_target, features_target, icd9_group, icd9_prefix, lab_ordinal, q,
    recode,
)
from tabwright.operators.relational import keep_best, or_vote
from tabwright.operators.sample import stratified_split
from tabwright.operators.scale import apply_fill, fit_fill, fit_standard, impute, normalize, standardize
from tabwright.operators.unitcode import fit_unit_encoder, unit_decode, unit_encode
from tabwright.session import materialize
from tabwright.sources.state import load_encoder, log_metrics, save_encoder
from tabwright.sources.tables import assign_types, path_exists, read_table, write_table

DIAGNOSES = ("diag_1", "diag_2", "diag_3")


def engineer_v1(df: DataFrame, target: str = "readmitted", days: bool = False, hot: bool = False) -> DataFrame:
    """Diagnosis prefixes, medication flags, then target recode and category encoding."""
    df = df.withColumns({c: icd9_prefix(q(c)) for c in DIAGNOSES if c in df.columns})
    return encode_categoricals(binary_flags(df), target, days, hot, order="native")


def engineer_v2(df: DataFrame, target: str = "readmitted", cat_cols: list[str] | None = None,
                drop_ids: bool = True) -> DataFrame:
    """One encounter per patient, recodes and groups, fills, label codes, binary target."""
    if {"patient_nbr", "time_in_hospital"} <= set(df.columns):
        # the fits below read the deduplicated table several times
        df = materialize(keep_best(df, "patient_nbr", "time_in_hospital", "encounter_id"))
    if drop_ids:
        df = drop_cols(df, ["patient_nbr", "race"])
    df = recode(df, "age", AGE_LEVELS)
    df = drop_cols(df, ["weight", "payer_code", "medical_specialty"])
    df = df.withColumns({c: icd9_group(q(c)) for c in DIAGNOSES if c in df.columns})
    df = lab_ordinal(binary_flags(df), "A1Cresult")
    df = apply_fill(df, fit_fill(df, "median"))
    df = label_encode(df, cat_cols, target, "string")
    return encode_target(df, target)


def prepare_v1(spark: SparkSession, source: str, out: str, keep_weight: bool = False) -> DataFrame:
    """Read, type, drop weight or keep rows having it, fill the lab columns, impute, write."""
    df = assign_types(read_table(spark, source))
    df = df.where(q("weight").isNotNull()) if keep_weight else drop_cols(df, ["weight"])
    df = lab_ordinal(df, "A1Cresult")
    df = impute(df, "mean")
    write_table(df, out)
    return read_table(spark, out)


def prepare_v2(spark: SparkSession, source: str, out: str, key: str = "encounter_id", target: str = "readmitted",
               test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Read, engineer, write the whole table, split by class and write both parts."""
    df = engineer_v2(assign_types(read_table(spark, source)), target)
    write_table(df, f"{out}.parquet", "parquet")
    whole = spark.read.parquet(f"{out}.parquet")
    tagged = stratified_split(whole, target, test, seed, key)
    for flag, name in ((0, "train"), (1, "test")):
        write_table(tagged.where(F.col("is_test") == flag).drop("is_test"), f"{out}_{name}.parquet", "parquet")
    return spark.read.parquet(f"{out}_train.parquet"), spark.read.parquet(f"{out}_test.parquet")


def ensemble(df: DataFrame, target: str, key: str, test: float = 0.1, seed: int = 3, trees: int = 100,
             hidden: tuple[int, ...] = (64, 32, 32, 32, 8), max_iter: int = 100) -> DataFrame:
    """Test predictions (key, label, pred) of a net on one-hot, scaled columns and a forest on label codes, joined by OR.

    Both models see the same stratified split; the net's columns are scaled by the train part.
    """
    tagged = materialize(stratified_split(df, target, test, seed, key))
    train, held = (tagged.where(F.col("is_test") == i).drop("is_test") for i in (0, 1))
    texts = [c for c in text_cols(tagged) if c not in (key, target)]
    hot = one_hot(tagged.drop("is_test"), texts, target)
    wide = [c for c in hot.columns if c not in (key, target)]
    parts = [hot.join(part.select(key), key, "left_semi") for part in (train, held)]
    fitted = fit_standard(parts[0], wide)
    parts = [materialize(models.assembled(standardize(part, wide, fitted), wide, target, [key])) for part in parts]
    net = models.feed_forward(len(wide), hidden=hidden, max_iter=max_iter).fit(parts[0])
    coded = label_encode(tagged, texts)
    narrow = [c for c in coded.columns if c not in (key, target, "is_test")]
    codes = [materialize(models.assembled(coded.where(F.col("is_test") == i), narrow, target, [key])) for i in (0, 1)]
    forest = models.random_forest(trees).fit(codes[0])
    votes = [scoring.threshold_predictions(models.score_table(m, x, [key])).select(key, "label", "pred") for m, x in ((net, parts[1]), (forest, codes[1]))]
    return or_vote(votes, key)


def encode_job(spark: SparkSession, source: str, out: str, key: str, prefix: str, seed: int = 42,
               schema: str | None = None) -> DataFrame:
    """Read, fill, encode with the encoder saved at ``prefix`` (fitted and saved there if there is none), write."""
    df = read_table(spark, source, schema)
    df = apply_fill(df, fit_fill(df.drop(key), "median"))
    if path_exists(spark, f"{prefix}.cols"):
        enc = load_encoder(spark, prefix)
    else:
        enc = fit_unit_encoder(df, key)
        save_encoder(enc, prefix)
    write_table(unit_encode(df, enc, seed, key), out, "parquet")
    return spark.read.parquet(out)


def decode_job(spark: SparkSession, source: str, out: str, prefix: str) -> DataFrame:
    """Read encoded rows, decode with the encoder saved at ``prefix``, write."""
    write_table(unit_decode(spark.read.parquet(source), load_encoder(spark, prefix)), out, "parquet")
    return spark.read.parquet(out)


@dataclass
class Experiment:
    """Settings of one train/evaluate run."""

    model: str = "Logistic"
    target: str = "readmitted"
    key: str = "encounter_id"
    test: float = 0.1
    seed: int = 3
    scale: str | None = "standard"
    select: bool = False
    step: int = 1
    cv: int = 5
    threshold: float = 0.3
    params: dict = field(default_factory=dict)


def _estimator(cfg: Experiment, n: int, width: int):
    makers = {
        "Logistic": lambda: models.logistic(n, **cfg.params),
        "DecisionTree": lambda: models.decision_tree(**cfg.params),
        "RandomForest": lambda: models.random_forest(**cfg.params),
        "XGBoost": lambda: models.boosted_trees(**cfg.params),
        "NN": lambda: models.feed_forward(width, **cfg.params),
    }
    if cfg.model not in makers:
        raise ValueError(f"unknown model '{cfg.model}'")
    return makers[cfg.model]()


def run_experiment(df: DataFrame, cfg: Experiment, test_df: DataFrame | None = None,
                   run_table: str | None = None, run: str = "run") -> DataFrame:
    """Split (unless a test table is given), scale, select, fit, score both splits, log: one metric row per split."""
    cols = [c for c in features_target(df, cfg.target)[0] if c != cfg.key]
    cols = [c for c in cols if c in numeric_cols(df)]
    if test_df is None:
        df = materialize(df)
        tagged = stratified_split(df, cfg.target, cfg.test, cfg.seed, cfg.key)
        train, test = (tagged.where(F.col("is_test") == i).drop("is_test") for i in (0, 1))
    else:
        features_target(test_df, cfg.target)
        train, test = df, test_df
    scaler = {"standard": standardize, "minmax": normalize}.get(cfg.scale)
    if scaler is not None:
        # both splits are scaled by the fit on the train split
        fitted = fit_standard(train, cols) if cfg.scale == "standard" else bounds_map(train, cols)
        train, test = scaler(train, cols, fitted), scaler(test, cols, fitted)
    if cfg.select:
        cols, _ = models.rfecv(cfg.model, train, cols, cfg.target, cfg.key, cfg.step, cfg.cv)
    ready = {n: materialize(models.assembled(t, cols, cfg.target)) for n, t in (("train", train), ("test", test))}
    model = _estimator(cfg, ready["train"].count(), len(cols)).fit(ready["train"])
    out = None
    for name, data in ready.items():
        row = scoring.metric_row(models.score_table(model, data), cfg.threshold).select(
            F.lit(name).alias("split"), "*")
        out = row if out is None else out.unionByName(row)
    if run_table:
        spark = df.sparkSession
        log_metrics(spark, run_table, run, {"model": cfg.model, "threshold": cfg.threshold, "seed": cfg.seed,
                                            "target": cfg.target, "n_features": len(cols), **cfg.params}, "param")
        for r in out.collect():
            log_metrics(spark, run_table, run,
                        {f"{r['split']}_{k}": v for k, v in r.asDict().items() if k != "split"})
    return out
