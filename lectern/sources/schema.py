"""Schemas of the tables."""

USERS = (
    "id bigint, username string, password_hash string, role string, avatar string, audio_speaker_a string, audio_speaker_b string, "
    "video_speaker string, voice_speaker string, created_at timestamp_ntz"
)
NOTEBOOKS = (
    "id bigint, user_id bigint, name string, description string, summary string, suggested_questions string, content_signature string, "
    "audio_path string, audio_status string, audio_error string, video_path string, video_status string, video_error string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
SOURCES = (
    "id bigint, notebook_id bigint, filename string, content_hash string, content_type string, char_count bigint, page_count int, status string, "
    "error_message string, created_at timestamp_ntz"
)
CHAT_MESSAGES = "id bigint, notebook_id bigint, role string, content string, sources_json string, metadata_json string, latency_ms int, created_at timestamp_ntz"
CONTENT_REGISTRY = "content_hash string, collection string, extracted_text string, char_count bigint, created_at timestamp_ntz"
CHUNKS = "content_hash string, chunk_index int, page int, filename string, document string, embedding array<float>"

#: Rows with these statuses count for questions, summaries and scripts.
USABLE = ("ready", "partial")
