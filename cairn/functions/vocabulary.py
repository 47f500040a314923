"""Vocabularies, limits, markers and texts that results must carry."""

SOURCE_TYPES = ("gutenberg_text", "wikisource", "wikipedia", "manual_upload")
SOURCE_STATUSES = ("pending", "scraping", "completed", "failed")
JOB_STATUSES = ("pending", "running", "completed", "failed")
ERAS = ("pre_colonial", "colonial_era", "post_independence", "contemporary")
AUTHOR_POSITIONS = ("indigenous_primary_text", "indigenous_scholar", "colonial_administrator", "missionary", "western_academic", "unknown_compiler")
TEXT_ROLES = ("primary_translation", "secondary_commentary", "tertiary_summary")
METHODS = ("oral_tradition", "textual_critical", "colonial_comparative_mythology", "archaeological_correlation", "archaeoastronomical_dating", "genetic_anthropological", "modern_academic_consensus", "unspecified")
AUTHOR_ORIGINS = ("indigenous_born", "foreign_born", "unknown")
EPISTEMIC_BASES = ("lived_practice", "textual_study_only", "mixed", "unknown")
ENTITY_TYPES = ("author", "institution")
SUGGESTION_STATUSES = ("pending", "reviewed")

ENUMS = {
    "source_type": SOURCE_TYPES,
    "status": SOURCE_STATUSES,
    "era": ERAS,
    "author_position": AUTHOR_POSITIONS,
    "text_role": TEXT_ROLES,
    "historiographical_method": METHODS,
    "author_origin": AUTHOR_ORIGINS,
    "author_epistemic_basis": EPISTEMIC_BASES,
}
#: Least and most characters; null passes.
LENGTHS = {"url": (1, 2048), "title": (0, 255), "tradition": (0, 50), "display_name": (1, 255), "pasted_text": (1, None)}

CHUNK_SIZE, CHUNK_OVERLAP = 220, 40
TOP_K, RELEVANCE = 5, 0.35
DIMENSION = 384
HOST_INTERVAL_S = 2.0
JOB_LIMIT_S = 300

BOOK_START, BOOK_END = "*** START OF", "*** END OF"
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
REFUSAL = "The corpus doesn't have any sources relevant enough to answer this question."

FACT_KEYS = ("birth_year", "death_year", "birth_region", "practice_regions", "occupation", "institutional_affiliations", "practice_lineage", "documented_critique_refs")
TRADITION_FACT_KEYS = ("born_within_tradition_context", "tradition_engagement")

REASON_NO_ENGAGEMENT = "the pasted text explicitly documents no direct engagement with this tradition"
REASON_LINEAGE = "practice_lineage documents a direct lineage or tradition of practice"
REASON_ENGAGEMENT = "the pasted text documents direct engagement with this tradition, but no explicit practice_lineage"
REASON_NO_BASIS = "insufficient facts to determine epistemic basis"
REASON_BORN_INSIDE = "the pasted text states the person was born/raised within this tradition's own community or region"
REASON_BORN_OUTSIDE = "the pasted text states the person was born/raised outside this tradition's own community or region"
REASON_NO_ORIGIN = "insufficient facts to determine origin relative to this tradition"
