"""Schemas of the inputs and of the model-run table."""

from __future__ import annotations

MIRROR = (
    "series STRING, file_size INT, compress_type STRING, compress_size INT, compress_pct STRING, "
    "date_time TIMESTAMP, CRC STRING, filename STRING"
)

CORPUS_COLUMNS = [
    "url", "stratum", "collection", "series", "level", "lang", "dl_year_mo", "dl_vol_iss", "dl_date", "dl_page",
    "dl_art_num", "dateline", "base", "string", "link_canon", "mirror_path", "md_citation_doi", "title",
    "md_citation_categories", "dl_cat", "md_kwds", "md_desc", "md_citation_author",
]
CORPUS_METADATA = ", ".join(f"`{c}` STRING" for c in CORPUS_COLUMNS)

COLLECTIONS = "url STRING, fmt STRING, collection STRING, content STRING, load_order INT, position BIGINT"

# Model-run table: column -> type.
MODEL_RUNS = {
    "time_key": "string",
    "type": "string",
    "num_workers": "int",
    "batch_size": "int",
    "num_documents": "int",
    "text_sha256": "string",
    "text_md5": "string",
    "convergence": "float",
    "perplexity": "float",
    "coherence": "float",
    "topics": "int",
    "alpha_str": "string",
    "n_alpha": "float",
    "beta_str": "string",
    "n_beta": "float",
    "passes": "int",
    "iterations": "int",
    "update_every": "int",
    "eval_every": "int",
    "chunksize": "int",
    "random_state": "int",
    "per_word_topics": "boolean",
    "top_words": "array<array<string>>",
    "create_pylda": "boolean",
    "create_pcoa": "boolean",
    "time": "timestamp",
    "end_time": "timestamp",
}

# Kept beside the run table, one row per run and kind.
ARTIFACT_KINDS = ["text", "text_json", "lda_model", "corpus", "dictionary"]
ARTIFACTS = "time_key STRING, kind STRING, payload STRING"

# Delimited export of the run table: column -> type; the first column is the exporter's row index.
RUNS_CSV = {"_index": "string", **{k: ("string" if v.startswith(("array", "boolean")) else "double" if v == "float" else v) for k, v in MODEL_RUNS.items()}}

# Older export: 22 columns, with the text path and without workers, flags and times.
RUNS_CSV_OLD = {
    "VAR1": "string", "type": "string", "batch_size": "int", "text": "string", "text_sha256": "string",
    "text_md5": "string", "convergence": "double", "perplexity": "double", "coherence": "double", "topics": "int",
    "alpha_str": "string", "n_alpha": "double", "beta_str": "string", "n_beta": "double", "passes": "int",
    "iterations": "int", "update_every": "int", "eval_every": "int", "chunksize": "int", "random_state": "int",
    "per_word_topics": "string", "top_words": "string",
}

# Typed table for the run rows: column -> type.
RUNS_TABLE = {
    "i": "string", "t": "string", "batch_size": "int", "text": "string", "text_sha256": "string",
    "text_md5": "string", "convergence": "double", "perplexity": "double", "coherence": "double", "topics": "int",
    "alpha_str": "string", "n_alpha": "double", "beta_str": "string", "n_beta": "double", "passes": "double",
    "iterations": "int", "update_every": "int", "eval_every": "int", "chunksize": "int", "random_state": "int",
    "per_word_topics": "boolean", "top_words": "string", "time": "timestamp",
}
