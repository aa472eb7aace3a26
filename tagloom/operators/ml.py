"""Text features, clusters, projections and object classes on Spark ML. Definitions differ from other libraries' in known ways:
idf is log((n + 1) / (df + 1)), silhouettes use squared Euclidean distance, and components have an arbitrary sign."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, PCA, CountVectorizer, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tfidf(docs: DataFrame, text: str, min_df: float = 3, max_df: float = 0.8, size: int = 2000) -> PipelineModel:
    """Words of letters, in df from min_df to max_df, the `size` most frequent; tf-idf of length 1 in `features`."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}]+"),
        CountVectorizer(inputCol="_words", outputCol="_tf", minDF=min_df, maxDF=max_df, vocabSize=size),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(docs)


def choose_k(features: DataFrame, ks: range = range(2, 9), seed: int = 42) -> tuple[KMeansModel, int]:
    """The k-means model whose silhouette is greatest."""
    best = None
    features = features.persist()
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(features)
        score = ClusteringEvaluator().evaluate(model.transform(features))
        if best is None or score > best[0]:
            best = (score, model, k)
    features.unpersist()
    return best[1], best[2]


def top_terms(model: KMeansModel, vocabulary: list[str], n: int = 8) -> list[list[str]]:
    """The heaviest words of each cluster's centre."""
    return [[vocabulary[i] for i in sorted(range(len(c)), key=lambda i: (-c[i], vocabulary[i]))[:n]] for c in model.clusterCenters()]


def project(features: DataFrame, k: int = 2) -> DataFrame:
    return PCA(k=k, inputCol="features", outputCol="projection").fit(features).transform(features)


def object_folds(objects: DataFrame, numeric: list[str], label: str, group: str, folds: int = 3, trees: int = 20, seed: int = 7) -> DataFrame:
    """fold, n, accuracy, baseline (share of the most frequent class in training), groups kept whole within a fold."""
    d = objects.withColumn("_fold", F.pmod(F.xxhash64(group), F.lit(folds)))
    d = StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc").fit(d).transform(d)
    d = VectorAssembler(inputCols=numeric, outputCol="features", handleInvalid="skip").transform(d).select("features", "label", "_fold").persist()
    rows = []
    for i in range(folds):
        train, test = d.filter(F.col("_fold") != i), d.filter(F.col("_fold") == i)
        n = test.count()
        if not n or train.isEmpty():
            continue
        model = RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=6).fit(train)
        accuracy = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(test))
        common = train.groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"]
        rows.append((i, n, accuracy, test.filter(F.col("label") == common).count() / n))
    d.unpersist()
    return objects.sparkSession.createDataFrame(rows, "fold int, n long, accuracy double, baseline double")
