"""Declared table schemas. Nothing is inferred on read."""

from __future__ import annotations

DRAFT = (
    "source_id STRING, entity_id STRING, raw_title STRING, raw_body STRING, raw_html STRING, "
    "raw_url STRING, raw_date TIMESTAMP, extracted_json STRING, pos BIGINT"
)

RAW_RECORD = (
    "id STRING, source_id STRING, entity_id STRING, raw_title STRING, raw_body STRING, "
    "raw_html STRING, raw_url STRING, raw_date TIMESTAMP, extracted_json STRING, checksum STRING, "
    "fetched_at TIMESTAMP, normalized_at TIMESTAMP"
)

RECORD = (
    "id STRING, external_id STRING, source_priority_rank INT, numero_gara_id STRING, "
    "data_pubblicazione TIMESTAMP, tipo_appalto STRING, descrizione STRING, ente STRING, "
    "importo DECIMAL(18,2), provincia STRING, regione STRING, comune STRING, area_text STRING, "
    "tipologia_gara_procedura STRING, tipo_strumento STRING, scadenza TIMESTAMP, criterio STRING, "
    "cig STRING, classifiche STRING, link_bando STRING, macrosettore STRING, "
    "stato_procedurale STRING, tipo_novita STRING, flag_concessione_ambito STRING, "
    "flag_ppp_doppio_oggetto STRING, flag_in_house_ambito STRING, flag_om STRING, "
    "flag_pre_gara STRING, tag_tecnico STRING, validation_level STRING, reliability_index STRING, "
    "is_weak_evidence BOOLEAN, score_commerciale INT, priorita_commerciale STRING, "
    "dedup_key STRING, master_record_id STRING, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)

RECORD_EVENT = (
    "id STRING, procurement_record_id STRING, event_type STRING, event_date TIMESTAMP, "
    "description STRING, source_url STRING, created_at TIMESTAMP"
)

ALERT = (
    "id STRING, procurement_record_id STRING, alert_type STRING, severity STRING, "
    "description STRING, is_open BOOLEAN, opened_at TIMESTAMP, closed_at TIMESTAMP"
)

SOURCE = (
    "id STRING, name STRING, source_type STRING, platform_type STRING, base_url STRING, "
    "sector_scope STRING, priority STRING, frequency STRING, reliability_score DECIMAL(4,2), "
    "productivity_score DECIMAL(6,2), publication_model STRING, source_priority_rank INT, "
    "active BOOLEAN, last_checked_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
)

ENTITY = (
    "id STRING, name STRING, entity_type STRING, region STRING, province STRING, "
    "municipality STRING, notes STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)

WATCHLIST_ITEM = (
    "id STRING, entity_id STRING, source_id STRING, url_gare STRING, url_esiti STRING, "
    "url_albo STRING, url_trasparenza STRING, url_determine STRING, frequency STRING, "
    "priority STRING, reliability_score DECIMAL(4,2), productivity_score DECIMAL(6,2), "
    "publication_model STRING, last_scan_at TIMESTAMP, active BOOLEAN, created_at TIMESTAMP, "
    "updated_at TIMESTAMP"
)

DOCUMENT = (
    "id STRING, source_id STRING, procurement_record_id STRING, filename STRING, mime_type STRING, "
    "storage_url STRING, text_content STRING, checksum STRING, created_at TIMESTAMP"
)

DAILY_REPORT = (
    "report_date DATE, total_new INT, total_updates INT, total_pregara INT, total_new_sources INT, "
    "report_json STRING, generated_at TIMESTAMP"
)

JOB_RUN = (
    "id STRING, job_name STRING, source_id STRING, status STRING, started_at TIMESTAMP, "
    "ended_at TIMESTAMP, records_found INT, records_valid INT, records_weak INT, "
    "duplicates_removed INT, error_message STRING"
)

# Feed layouts ------------------------------------------------------------------------------------

LOT_FEED = (
    "`#Denominazione_Bando` STRING, Denominazione_Lotto STRING, Categoria_Merceologica STRING, "
    "Data_Pubblicazione STRING, Tipo_Procedura STRING, Tipo_Strumento STRING, Base_Asta STRING, "
    "Identificativo_Lotto STRING, Data_Attivazione STRING, Data_Termine STRING"
)

# Language-keyed fields stay maps so that "first language in the document" keeps its meaning.
NOTICE = (
    "struct<`publication-number`: string, `notice-title`: map<string,string>, "
    "`buyer-name`: map<string,string>, `publication-date`: string, "
    "links: struct<htmlDirect: map<string,string>>, `procedure-type`: string, "
    "`total-value`: string, `estimated-value-lot`: string, "
    "`deadline-receipt-tender-date-lot`: string, `classification-cpv`: array<string>, "
    "`buyer-country`: string>"
)

RSS_ITEM = (
    "title STRING, link STRING, guid STRING, description STRING, summary STRING, pubDate STRING, "
    "published STRING, updated STRING"
)

PAGE = "source STRING, url STRING, html STRING"
