"""Declared schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

SCORES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("sample_id", T.LongType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("distributions", T.StringType()),
        T.StructField("ll2_model", T.DoubleType()),
        T.StructField("ll2_generator", T.DoubleType()),
        T.StructField("n_token_response", T.LongType()),
        T.StructField("ood", T.IntegerType()),
    ]
)

DRAWS = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("ll2_model", T.DoubleType()),
        T.StructField("ll2_generator", T.DoubleType()),
        T.StructField("n_token", T.LongType()),
    ]
)

EPS_TABLE = T.StructType(
    [
        T.StructField("T", T.IntegerType()),
        T.StructField("log10_eps", T.DoubleType()),
        T.StructField("k_min", T.DoubleType()),
        T.StructField("k_mid", T.DoubleType()),
        T.StructField("k_max", T.DoubleType()),
        T.StructField("log10_cr_10", T.DoubleType()),
        T.StructField("log10_cr_median", T.DoubleType()),
        T.StructField("log10_cr_90", T.DoubleType()),
    ]
)

# Older k/epsilon tables name the percentile columns without the log10 prefix.
EPS_TABLE_OLD_NAMES = {"cr_10": "log10_cr_10", "cr_median": "log10_cr_median", "cr_90": "log10_cr_90"}

GATE_RESULT = T.StructType(
    [
        T.StructField("abstained", T.BooleanType()),
        T.StructField("num_samples", T.LongType()),
        T.StructField("log_prob_f", T.DoubleType()),
        T.StructField("log_prob_g", T.DoubleType()),
        T.StructField("prompt_text", T.StringType()),
        T.StructField("generated_text", T.StringType()),
        T.StructField("target_text", T.StringType()),
        T.StructField("decision", T.StringType()),
    ]
)

GATE_RESULTS_FILE = T.StructType(
    [
        T.StructField("config", T.MapType(T.StringType(), T.StringType())),
        T.StructField("results", T.ArrayType(GATE_RESULT)),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

PROMPT_RESPONSE_FILE = T.StructType(
    [
        T.StructField(
            "data",
            T.ArrayType(
                T.StructType([T.StructField("prompt", T.StringType()), T.StructField("response", T.StringType())])
            ),
        )
    ]
)

QA_CORPUS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("contexts", T.ArrayType(T.StringType())),
        T.StructField("answers", T.ArrayType(T.StringType())),
        T.StructField("title", T.StringType()),
    ]
)
