"""Table shapes as DDL strings."""

ARTICLE = (
    "id string, url string, canonical_url string, title string, author string, site_name string, excerpt string, "
    "content_html string, word_count int, reading_min int, lang string, state string, favorite boolean, "
    "progress double, tags array<string>, source string, added_at bigint, read_at bigint, modified_at bigint, "
    "deleted boolean"
)
MANIFEST = "site string, url string, why string, finalUrl string, bytes bigint"
IMPORT_ROW = "url string, title string, tags array<string>, archived boolean, added_at bigint"
IMAGE = "key string, url string, bytes bigint, type string, saved_at bigint"
PATCH = "id string, at bigint, seq bigint, fields array<string>"
ARTICLE_COLUMNS = [field.split()[0] for field in ARTICLE.split(", ")]
