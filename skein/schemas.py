"""Schemas of the engine's entities, as DDL strings."""

SOURCE = "id string, title string, short_title string, description string, copyright string, display_mode string, context_words int, link_template string, official_url string, free_url string, color string, sort_order int, enabled boolean"
PASSAGE = "id string, source_id string, title string, sequence int, date string, page_ref string, chapter_ref string, text string, link_data map<string,string>"
QUERY = "query_id string, q string, source_filter array<string>"
LOG = "key string, ts string, q string, result_count double, source_filter array<string>"
CHAPTER = "chapter_ref string, title string, start_page int, end_page int"
SYNONYM = "term string, synonyms array<string>"
EXCEPTION = "match array<string>, title string, body string, link struct<label:string,url:string>"
PAGE_TEXT = "source_id string, page int, text string"

#: Names of fields in JSON files, by column.
SOURCE_JSON = {"short_title": "shortTitle", "display_mode": "displayMode", "context_words": "contextWords", "link_template": "linkTemplate", "official_url": "officialUrl", "free_url": "freeUrl", "sort_order": "sortOrder"}
PASSAGE_JSON = {"source_id": "sourceId", "page_ref": "pageRef", "chapter_ref": "chapterRef", "link_data": "linkData"}
DISPLAY_MODES = ("full-text", "concordance-only", "snippet")
COPYRIGHTS = ("public-domain", "protected", "unknown")
