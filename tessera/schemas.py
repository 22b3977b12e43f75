"""Schemas of the tables that the engine passes between its operators, as DDL."""

PAGE_CHUNK = "chunk_id string, text string, source string, category string, page int, chunk_index int, total_chunks int, word_count int, char_count int, has_table boolean, topics array<string>"
SEMANTIC_CHUNK = (
    "chunk_id string, parent_id string, content string, context_header string, header_path string, intent string, semantic_keywords array<string>, "
    "sentences array<string>, sentence_ids array<string>, children_ids array<string>, page_numbers array<int>, propositions array<string>, topics array<string>, "
    "entities map<string,array<string>>, basin string, region string, boundary_score double, noise_ratio double, total_sentences int"
)
SENTENCE = "sentence_id string, chunk_id string, sentence string, position int, window_before string, window_after string, window_full string"
VECTOR = "id string, embedding array<float>, text string, metadata map<string,string>"
NODE = "entity string, type string, frequency long, documents array<string>"
EDGE = "src string, dst string, relation string, doc_id string"
MEMORY = "conv_id long, turn long, role string, text string"
QUESTION = "id int, question string, expected_answer string, key_concepts array<string>"
HIERARCHY = "node_id string, level string, parent_id string"
