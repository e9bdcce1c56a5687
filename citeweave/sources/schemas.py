"""Schemas of stored tables; nothing is inferred."""

OUTLINE = "array<struct<id:string,title:string,level:int,page_start:int,page_end:int>>"
DOCUMENTS = (
    f"id string, filename string, status string, page_count int, outline {OUTLINE}, parser_meta map<string,string>, ingestion_version int, "
    "blob_path string, blob_url string, workflow_run_id string, error_message string, created_at timestamp, updated_at timestamp"
)
CHUNKS = "document_id string, id string, source_id string, page_from int, page_to int, section_path array<string>, chunk_type string, text string, ord int"
EVENTS = "document_id string, seq long, field string, value string, error_message string, at timestamp"
ITEMS = "document_id string, page int, item_no int, str string, transform array<double>"
LINES = "document_id string, page int, line_no int, text string, x double, y double, font_size double"
JSON_STORE = "documents array<struct<id:string,filename:string,status:string,pageCount:int,errorMessage:string>>, chunks array<struct<id:string,documentId:string,sourceId:string,pageFrom:int,pageTo:int,sectionPath:array<string>,chunkType:string,text:string>>"
