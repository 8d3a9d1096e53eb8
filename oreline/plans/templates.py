"""Twelve ready step lists. Each builder takes the roles of the columns and returns steps for ``run_steps``."""

from __future__ import annotations

from oreline.plans.steps import Step


def classification(target, key, numbers, texts):
    return [
        Step("clean", "imputer", {"strategy": "median", "columns": [*numbers, *texts]}),
        Step("dedup", "deduplicate", {"columns": [key], "order": [key]}),
        Step("train", "classification", {"target": target, "key": key, "models": ["logistic", "tree"], "columns": [*numbers, *texts]}),
    ]


def regression(target, key, numbers, texts):
    return [
        Step("clean", "imputer", {"strategy": "mean", "columns": numbers}),
        Step("bounds", "outlier_removal", {"column": target, "method": "iqr", "factor": 3.0}),
        Step("train", "regression", {"target": target, "key": key, "models": ["linear", "tree"], "columns": [*numbers, *texts]}),
    ]


def clustering(numbers, k=3):
    return [Step("clean", "imputer", {"strategy": "median", "columns": numbers}), Step("cluster", "clustering", {"columns": numbers, "k": k})]


def anomaly(key, numbers):
    return [
        Step("clean", "imputer", {"strategy": "median", "columns": numbers}),
        Step("score", "anomaly_detection", {"key": key, "columns": numbers, "method": "zscore"}),
        Step("keep", "filter", {"condition": "anomaly"}),
    ]


def feature_work(formulas, numbers, texts):
    return [
        Step("derive", "feature_engineering", {"formulas": formulas}),
        Step("encode", "encoder", {"method": "onehot", "columns": texts}),
        Step("scale", "scaler", {"method": "standard", "columns": numbers}),
    ]


def components(numbers, n=2):
    return [Step("clean", "imputer", {"strategy": "mean", "columns": numbers}), Step("pca", "pca", {"columns": numbers, "n": n})]


def credit(target, key, numbers, texts):
    return [
        Step("bounds", "outlier_removal", {"column": numbers[0], "method": "percentile"}),
        Step("clean", "imputer", {"strategy": "median", "columns": numbers}),
        Step("split", "split", {"key": key, "stratify": target, "train_percent": 75}),
        Step("train", "classification", {"target": target, "key": key, "models": ["logistic", "forest"], "columns": [*numbers, *texts]}),
    ]


def text_classification(target, key, text):
    return [
        Step("tokens", "tokenizer", {"column": text}),
        Step("size", "feature_engineering", {"formulas": {"size": "log(1 + n_chars)"}}),
        Step("train", "classification", {"target": target, "key": key, "models": ["logistic"], "columns": ["size", "n_chars"]}),
    ]


def churn(target, key, numbers, texts, condition):
    return [
        Step("active", "filter", {"condition": condition}),
        Step("encode", "encoder", {"method": "frequency", "columns": texts}),
        Step("train", "classification", {"target": target, "key": key, "models": ["tree", "boosting"], "columns": numbers}),
    ]


def series(value, order, by):
    return [
        Step("lags", "lag_features", {"value": value, "order": order, "by": by, "window": 7}),
        Step("full", "filter", {"condition": f"{value}_mean7 != null"}),
        Step("split", "split", {"key": None, "order": order, "train_percent": 80}),
    ]


def tuning(target, key, numbers, texts, model="tree"):
    return [
        Step("check", "cross_validation", {"target": target, "task": "classification", "key": key, "model": model, "columns": [*numbers, *texts]}),
        Step("search", "tuning", {"target": target, "task": "classification", "key": key, "model": model, "columns": [*numbers, *texts]}),
    ], []  # both read the source


def cleaning(key, numbers, texts):
    return [
        Step("dedup", "deduplicate", {}),
        Step("fill", "imputer", {"strategy": "median", "columns": [*numbers, *texts]}),
        Step("bounds", "outlier_removal", {"column": numbers[0], "method": "zscore"}),
        Step("sort", "sort", {"columns": [key]}),
    ]


TEMPLATES = {
    f.__name__: f
    for f in (classification, regression, clustering, anomaly, feature_work, components, credit, text_classification, churn, series, tuning, cleaning)
}
