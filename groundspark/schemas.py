"""Schemas of the logical tables, one for each entity; nested lists are child tables with an explicit ordinal."""

from __future__ import annotations

DOCUMENTS = "doc_id string, text string"
CHUNKS = "chunk_id string, doc_id string, chunk_index int, text string, start_char int, end_char int"
QUESTIONS = "qid string, question string, answers array<string>, subject_title string, subject string, prop string"
HITS = "qid string, rank int, chunk_id string, score double"
GRADED = "qid string, rank int, chunk_id string, p_correct double, p_ambiguous double, p_wrong double, label string, confidence double"
CONTEXT = "qid string, passage_no int, chunk_id string, text string"
SENTENCES = "qid string, sent_idx int, text string, raw string, numbers array<int>, had_citation boolean"
CITATIONS = "qid string, sent_idx int, cite_pos int, passage_no int, chunk_id string"
VERDICTS = "qid string, sent_idx int, supported boolean, entailment_score double, supporting_chunk_id string, nli_label string, uncited boolean"
ANSWERS = "qid string, text string, abstained boolean, abstain_reason string, repair_attempts int"
ASQA = "sample_id string, question string, answer string, qa_pairs array<struct<short_answers: array<string>>>, docs array<struct<id: string, title: string, text: string>>"
USAGE = "call_id long, input_tokens long, output_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long, cached boolean, latency_s double"
BASELINE = "metric string, value double, min double, max double, direction string, command string, note string"
PAYLOAD = "sentences array<struct<text: string, citations: array<int>>>"
REPAIR = "repairable boolean, text string, citations array<int>"
