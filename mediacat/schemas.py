"""Schemas of the catalog's tables, as DDL."""

from __future__ import annotations

TABLES = {
    "files": "id long, file_path string, file_hash string, perceptual_hash string, file_size long, file_type string, mime_type string, ingested_at timestamp, analyzed_at timestamp, processed boolean, error string",
    "events": "id long, name string, description string, start_time timestamp, end_time timestamp, location_name string, latitude double, longitude double, radius_km double, file_count int, cover_file_id long",
    "event_files": "event_id long, file_id long, sequence int",
    "embeddings": "file_id long, embedding_type string, embedding array<float>, dimensions int, model_name string, generated_at timestamp",
    "face_detections": "id long, file_id long, person_id long, bbox_x1 int, bbox_y1 int, bbox_x2 int, bbox_y2 int, embedding array<float>, confidence double, gender string, age int, eye_open_prob double, cluster_id int",
    "persons": "id long, name string, custom_name string, representative_embedding array<float>, first_seen timestamp, last_seen timestamp, photo_count int, face_count int, extra_metadata map<string,string>",
    "analysis_results": "file_id long, caption string, tags array<string>, objects array<string>, mood string, contains_text boolean, is_sensitive boolean, aesthetic_score double, sharpness double, color_palette array<array<int>>, video_duration double, scene_changes array<double>, latitude double, longitude double, altitude double, location_name string, analyzed_at timestamp, analysis_version string",
    "processing_queue": "id long, file_id long, task_type string, priority int, status string, created_at timestamp, started_at timestamp, completed_at timestamp, error string, retry_count int",
    "ingestion_logs": "started_at timestamp, finished_at timestamp, ingested int, duplicates int, errors int, total_size long, details map<string,long>",
    "settings": "key string, value string, updated_at timestamp",
}
EVENTS = "event_type string, src_path string, dest_path string, is_directory boolean, ts timestamp"
