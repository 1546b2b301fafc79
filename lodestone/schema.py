"""Schemas of the engine's tables, as DDL."""

CHUNK = "id string, content string, filepath string, start_line int, end_line int, node_type string, name string, language string, imports array<string>, exports array<string>, types array<string>"
FILES = "repository_id string, filepath string, content string"
EMBEDDINGS = f"repository_id string, {CHUNK}, embedding array<float>"
GRAPH_NODES = "filepath string, exports array<string>, imports array<struct<symbol:string,from:string,is_type:boolean,line:int>>"
GRAPH_EDGES = "src string, dst string, seq long"
REPOSITORIES = "id string, owner string, name string, url string, description string, language string, stars int, default_branch string, file_count int, chunk_count int, status string, indexed_at timestamp"
TRACES = (
    "id string, timestamp long, query string, repository_id string, mode string, "
    "spans array<struct<name:string,start_ms:long,end_ms:long,duration_ms:long>>, "
    "token_usage struct<input_tokens:long,output_tokens:long,total_tokens:long>, "
    "cost_estimate struct<embedding_cost:double,llm_input_cost:double,llm_output_cost:double,total_cost:double>, "
    "chunks_retrieved int, reranker_used string, success boolean, error string"
)
INDEX_META = "version string, indexed_at timestamp, model string, dimension int, files long, chunks long"
