"""Language tags as columns, and the language dimension."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ISO 639 codes, English names, native names, written right to left.
LANGUAGES = [
    ("af", "Afrikaans", "Afrikaans", False),
    ("ar", "Arabic", "العربية", True),
    ("bg", "Bulgarian", "Български", False),
    ("bn", "Bengali", "বাংলা", False),
    ("bs", "Bosnian", "Bosanski", False),
    ("ca", "Catalan", "Català", False),
    ("cs", "Czech", "Čeština", False),
    ("cy", "Welsh", "Cymraeg", False),
    ("da", "Danish", "Dansk", False),
    ("de", "German", "Deutsch", False),
    ("el", "Greek", "Ελληνικά", False),
    ("en", "English", "English", False),
    ("es", "Spanish", "Español", False),
    ("et", "Estonian", "Eesti", False),
    ("eu", "Basque", "Euskara", False),
    ("fa", "Persian", "فارسی", True),
    ("fi", "Finnish", "Suomi", False),
    ("fil", "Filipino", "Filipino", False),
    ("fr", "French", "Français", False),
    ("gl", "Galician", "Galego", False),
    ("gu", "Gujarati", "ગુજરાતી", False),
    ("he", "Hebrew", "עברית", True),
    ("hi", "Hindi", "हिन्दी", False),
    ("hr", "Croatian", "Hrvatski", False),
    ("hu", "Hungarian", "Magyar", False),
    ("id", "Indonesian", "Bahasa Indonesia", False),
    ("is", "Icelandic", "Íslenska", False),
    ("it", "Italian", "Italiano", False),
    ("ja", "Japanese", "日本語", False),
    ("km", "Khmer", "ភាសាខ្មែរ", False),
    ("kn", "Kannada", "ಕನ್ನಡ", False),
    ("ko", "Korean", "한국어", False),
    ("lt", "Lithuanian", "Lietuvių", False),
    ("lv", "Latvian", "Latviešu", False),
    ("mk", "Macedonian", "Македонски", False),
    ("ml", "Malayalam", "മലയാളം", False),
    ("mr", "Marathi", "मराठी", False),
    ("ms", "Malay", "Bahasa Melayu", False),
    ("nb", "Norwegian", "Norsk", False),
    ("ne", "Nepali", "नेपाली", False),
    ("nl", "Dutch", "Nederlands", False),
    ("pl", "Polish", "Polski", False),
    ("pt", "Portuguese", "Português", False),
    ("ro", "Romanian", "Română", False),
    ("ru", "Russian", "Русский", False),
    ("si", "Sinhala", "සිංහල", False),
    ("sk", "Slovak", "Slovenčina", False),
    ("sl", "Slovenian", "Slovenščina", False),
    ("sq", "Albanian", "Shqip", False),
    ("sr", "Serbian", "Српски", False),
    ("sv", "Swedish", "Svenska", False),
    ("sw", "Swahili", "Kiswahili", False),
    ("ta", "Tamil", "தமிழ்", False),
    ("te", "Telugu", "తెలుగు", False),
    ("th", "Thai", "ไทย", False),
    ("tr", "Turkish", "Türkçe", False),
    ("uk", "Ukrainian", "Українська", False),
    ("ur", "Urdu", "اردو", True),
    ("vi", "Vietnamese", "Tiếng Việt", False),
    ("zh", "Chinese", "中文", False),
]

# The region a bare language is completed with for speech.
SPEECH_REGION = {
    "de": "de-DE", "en": "en-US", "fr": "fr-FR", "es": "es-ES", "it": "it-IT",
    "nl": "nl-NL", "pt": "pt-PT", "pl": "pl-PL", "tr": "tr-TR", "ru": "ru-RU",
}


def languages(spark: SparkSession) -> DataFrame:
    """The language dimension: sixty rows, safe to broadcast."""
    return spark.createDataFrame(LANGUAGES, "code string, name string, endonym string, rtl boolean")


def base_code(tag: Column) -> Column:
    """`pt_BR`, `DE`, `zh-Hant-TW` to `pt`, `de`, `zh`; blank to null."""
    first = F.split_part(F.replace(F.lower(F.trim(tag)), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
    return F.nullif(first, F.lit(""))


def speech_language(tag: Column) -> Column:
    """A tag with a region, in the casing speech software expects, or null."""
    clean = F.regexp_replace(F.lower(F.trim(tag)), "_", "-")
    regional = F.concat(
        F.split_part(clean, F.lit("-"), F.lit(1)), F.lit("-"), F.upper(F.split_part(clean, F.lit("-"), F.lit(2)))
    )
    known = F.create_map(*(F.lit(x) for pair in SPEECH_REGION.items() for x in pair))
    return F.when(clean.rlike(r"^[a-z]{2,3}-[a-z0-9]{2,8}$"), regional).otherwise(F.try_element_at(known, clean))


def with_language(df: DataFrame, tag: str) -> DataFrame:
    """Attach native label, English name and writing direction to a tag column."""
    dim = F.broadcast(languages(df.sparkSession)).withColumnsRenamed({"code": "_code"})
    code = base_code(F.col(tag))
    fallback = F.coalesce(F.upper(code), F.lit("Unknown"))
    return (
        df.join(dim, code == F.col("_code"), "left")
        .withColumns(
            {
                "lang_label": F.coalesce("endonym", fallback),
                "lang_name": F.coalesce("name", fallback),
                "lang_rtl": F.coalesce("rtl", F.lit(False)),
            }
        )
        .drop("_code", "name", "endonym", "rtl")
    )
