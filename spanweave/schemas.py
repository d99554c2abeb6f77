"""Schemas at the boundaries; further columns of inputs are ignored by every operator."""

ENTITY_DDL = (
    "graph_id string, source_file string, seq long, entity_type string, name string, start_line int, end_line int, "
    "start_byte int, end_byte int, snippet string, parent_type string, parent_name string, module_name string, imported_items array<string>"
)
CHUNK_DDL = "graph_id string, id string, text string, source_file string, language string, chunk_index int, start_line int, end_line int, token_count int"
NODE_COLUMNS = ["graph_id", "id", "labels", "entity_type", "name", "source_file", "start_line", "end_line", "description"]
EDGE_COLUMNS = ["graph_id", "src", "dst", "rel_type", "props"]
EDGE_PROPS = "struct<line:int,start:int,end:int,module:string,items:string,is_builtin:boolean>"
