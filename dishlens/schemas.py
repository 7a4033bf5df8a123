"""Read schemas, as DDL strings."""

REVIEW = (
    "review_id STRING, user_id STRING, business_id STRING, stars FLOAT, "
    "useful INT, funny INT, cool INT, text STRING"
)
REVIEW_EVENT = (
    "review_id STRING, user_id STRING, business_id STRING, stars FLOAT, "
    "useful FLOAT, funny FLOAT, cool FLOAT, text STRING"
)
BUSINESS = "business_id STRING, name STRING, city STRING, state STRING, categories STRING"
CHUNK = (
    "chunk_id STRING, review_id STRING, chunk_ix INT, chunk_text STRING, embedding ARRAY<FLOAT>"
)
INSPECTION_TEXT_COLUMNS = [
    "camis", "dba", "boro", "building", "street", "zipcode", "phone", "cuisine_description",
    "inspection_date", "action", "violation_code", "violation_description", "critical_flag",
    "score", "grade", "grade_date", "record_date", "inspection_type", "community_board",
    "council_district", "census_tract", "bin", "bbl", "nta", "location",
]
INSPECTION = (
    ", ".join(f"{c} STRING" for c in INSPECTION_TEXT_COLUMNS) + ", latitude DOUBLE, longitude DOUBLE"
)
INSPECTION_EVENT = INSPECTION + ", id STRING, event_id STRING, created_at STRING"
RESTAURANT = (
    "id STRING, camis STRING, yelp_id STRING, dba STRING, boro STRING, building STRING, "
    "street STRING, zipcode STRING, phone STRING, address STRING, cuisine STRING, "
    "latitude DOUBLE, longitude DOUBLE, nta STRING, status STRING, website_url STRING, "
    "menu_urls ARRAY<STRING>, url_source STRING, extraction_tier STRING, item_count INT, "
    "scraped_at TIMESTAMP, last_error STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
MODIFIER = "STRUCT<name: STRING, price: DOUBLE>"
MENU_ENTRY = (
    "STRUCT<menu_item_id: STRING, dish_name: STRING, description: STRING, menu_section: STRING, "
    "price: DOUBLE, stated_ingredients: ARRAY<STRING>, has_full_ingredients: BOOLEAN, "
    f"modifiers: ARRAY<{MODIFIER}>, source_url: STRING, scraped_at: STRING>"
)
MENU_EXTRACTION = (
    f"business_id STRING, source_url STRING, restaurant_name STRING, items ARRAY<{MENU_ENTRY}>, "
    "event_id STRING, job_id STRING, attempt INT, discovery_event_id STRING, "
    "extraction_tier STRING, created_at STRING"
)
DISCOVERY = (
    "camis STRING, dba STRING, prompt STRING, response_text STRING, source_urls ARRAY<STRING>, "
    "model STRING, event_id STRING, job_id STRING, attempt INT, created_at STRING"
)
CATALOG = (
    "ingredient STRING, level STRING, groups ARRAY<STRING>, notes STRING, "
    "substitutions ARRAY<STRING>, updated_at TIMESTAMP"
)
SCRAPE_EVENT = (
    "camis STRING, seq BIGINT, ts TIMESTAMP, status STRING, item_count INT, last_error STRING"
)
REGULATORY_UPDATE = (
    "id STRING, source_id STRING, source_url STRING, cas_number STRING, substance_name STRING, "
    "change_type STRING, description STRING, effective_date STRING, raw_path STRING, "
    "extracted_at TIMESTAMP"
)
STRUCTURED_UPDATE = (
    "cas_number STRING, substance_name STRING, change_type STRING, description STRING, "
    "effective_date STRING, source_url STRING"
)
