"""Schemas of what the engine reads and writes."""

from __future__ import annotations

PARAGRAPH = "struct<paragraph:int,text:string,gloss:string,text_raw:string>"
CORPUS = f"title string, source string, sections array<struct<section:int,paragraphs:array<{PARAGRAPH}>>>"
#: The nested corpus as its JSON files name its fields.
CORPUS_FILE = "title string, source string, simanim array<struct<siman:int,hilchot_group:string,siman_sign:string,seifim:array<struct<seif:int,text:string,hagah:string,text_raw:string>>>>"
CHUNKS = "chunk_id long, section int, paragraph int, label string, text string"
RICH = "chunk_id long, section int, paragraph int, text string, summary string, context_prefix string, modern_summary string, questions array<string>, encoding_text string, word_count long"
QUERIES = "q_id long, question string, answer string, section int, paragraph int"
HITS = "q_id long, rank int, chunk_id long, score double"
VECTORS = "chunk_id long, vector array<double>"
HEADINGS = "section string, group string, title string"
CHAT = "messages array<struct<role:string,content:string>>"

#: Headers of question files, lower case and stripped, and what they mean.
QUERY_HEADERS = {
    "#": "q_id", "id": "q_id", "שאלה": "question", "question": "question", "query": "question", "תשובה": "answer", "answer": "answer",
    "סימן": "section", "siman": "section", "section": "section", "סעיף": "paragraph", "seif": "paragraph", "paragraph": "paragraph",
}
