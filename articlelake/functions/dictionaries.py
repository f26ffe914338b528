"""Word lists and small tables the cleaning and narration columns use.

Abbreviations are segmentation suppressions of the Unicode CLDR (locales en, de, fr, es), and
occupations those of the press in the ISCO-08 groups 2641 and 2642. Labels of page furniture
and gates were written for this library, many as counterparts in four languages. Where
results depend on a certain wording, it stands apart under "Fixed values".
"""

# How a block begins when it is page furniture rather than article text.
FURNITURE_LABELS = {
    "en": [
        "about us", "advertisement", "advertising", "all rights reserved", "back to top", "contact us", "cookie policy",
        "cookie settings", "copyright", "create an account", "follow us", "join us", "leave a comment", "log in", "newsletter",
        "next article", "previous article", "print this page", "privacy policy", "promoted", "search results", "share this",
        "show comments", "sign in", "sign up", "skip to", "terms of service", "terms of use",
        "accept all cookies", "accept cookies", "photo credit", "photo credits", "related articles", "related stories", "this site uses cookies",
    ],
    "de": [
        "agb", "anmelden", "anzeige", "datenschutz", "einloggen", "impressum", "kommentar schreiben", "kommentare anzeigen",
        "kontakt", "nach oben", "nächster artikel", "newsletter", "nutzungsbedingungen", "registrieren", "seite drucken",
        "teilen", "über uns", "voriger artikel", "werbung",
        "alle cookies akzeptieren", "bildnachweis", "bildnachweise", "verwandte artikel", "wenn sie über links", "zum inhalt springen",
    ],
    "fr": [
        "article précédent", "article suivant", "contactez-nous", "créer un compte", "gestion des cookies", "haut de page",
        "imprimer cette page", "laisser un commentaire", "mentions légales", "partager", "politique de confidentialité",
        "publicité", "qui sommes-nous", "se connecter", "suivez-nous", "tous droits réservés",
        "accepter les cookies", "accepter tous les cookies", "aller au contenu", "articles liés", "crédit photo", "crédits photo",
        "lorsque vous achetez via", "sur le même sujet",
    ],
    "es": [
        "artículo anterior", "artículo siguiente", "aviso legal", "compartir", "contacto", "crear una cuenta", "deja un comentario",
        "imprimir esta página", "iniciar sesión", "política de cookies", "política de privacidad", "publicidad", "quiénes somos",
        "síguenos", "todos los derechos reservados", "volver arriba",
        "aceptar cookies", "aceptar las cookies", "aceptar todas las cookies", "artículos relacionados", "crédito de la imagen",
        "créditos de la imagen", "cuando compras a través de", "ir al contenido", "saltar al contenido",
    ],
}
FURNITURE_SIGNS = ["©"]
# Furniture that has to be recognised in this wording.
FURNITURE_WORDINGS = [
    "when you buy through", "when you purchase through", "we may earn a commission", "image credit", "image credits",
    "zum hauptinhalt", "mehr zum thema", "cookie zustimmen", "cookie akzeptieren", "cookies zustimmen", "cookies akzeptieren",
]
# Words that article text begins with as well: furniture only where nothing follows them.
LONE_LABELS = {
    "en": ["home page", "most popular", "most read"],
    "de": ["meistgelesen", "startseite"],
    "fr": ["accueil", "les plus lus"],
    "es": ["lo más leído", "página de inicio"],
}

# Who writes for a newspaper; a block that only says so about someone is no article text.
OCCUPATIONS = ["author", "columnist", "correspondent", "critic", "editor", "journalist", "reporter", "writer"]

# What a page says when it answers with its gate instead of its text.
GATE_LABELS = {
    "en": [
        "access denied", "are you a robot", "enable cookies", "for subscribers only", "javascript is disabled", "javascript is required",
        "log in to read", "register to continue", "register to read", "subscribe now to", "subscribe to", "turn on javascript",
        "verify you are human",
        "accept all cookies to", "accept cookies to", "create a free account", "enable javascript", "sign in to continue", "sign in to read",
    ],
    "de": [
        "abonnieren, um", "anmelden, um weiterzulesen", "bitte aktivieren sie cookies", "bitte aktivieren sie javascript",
        "javascript ist deaktiviert", "nur für abonnenten", "registrieren, um weiterzulesen", "zugriff verweigert",
        "akzeptieren sie cookies", "javascript aktivieren",
    ],
    "fr": [
        "accès refusé", "activez javascript", "activez les cookies", "article réservé", "connectez-vous pour lire",
        "javascript est désactivé", "pour nos abonnés",
        "abonnez-vous pour", "acceptez les cookies", "déjà abonné", "réservé aux abonnés",
    ],
    "es": [
        "acceso denegado", "active javascript", "habilite las cookies", "inicia sesión para leer", "javascript está desactivado",
        "regístrate para leer", "solo para suscriptores",
        "acepta las cookies", "acepte las cookies", "exclusivo para suscriptores", "suscríbete para", "ya eres suscriptor",
    ],
}

# Gates that have to be recognised in this wording.
GATE_WORDINGS = [
    "already a subscriber", "create your free account", "weiterlesen mit", "artikel weiterlesen", "jetzt abonnieren",
    "cookies zustimmen", "cookies akzeptieren",
]

# Words that name a picture or its origin before a colon, in four languages.
PICTURE_WORDS = [
    "bild", "courtesy", "foto", "fotografía", "fotografie", "fuente", "grafik", "graphic", "illustration", "ilustración", "image",
    "imagen", "photo", "photograph", "photographie", "picture", "quelle", "source",
]
CREDIT = r"(?i)^(?:" + "|".join(PICTURE_WORDS) + r")(?:\s+(?:by|von|par|por|de))?\s*[:：]"

# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = [
    # en
    "Adj", "Adv", "Approx", "Capt", "Co", "Col", "Comm", "Corp", "Dept", "Dr", "Ed", "Esq", "Etc", "etc", "Fig", "Gen", "Gov", "Hon",
    "Inc", "Jr", "Lt", "Ltd", "Maj", "Mr", "Mrs", "Ms", "Mt", "No", "Org", "Prof", "Rep", "Rev", "Sen", "Sgt", "Sr", "St", "Vol", "vs",
    # de
    "a", "Abb", "Abk", "Abs", "Abt", "allg", "Anm", "Art", "Aufl", "Bd", "bes", "bspw", "bzgl", "bzw", "ca", "Chr", "d", "Dipl", "ebd",
    "evtl", "exkl", "ff", "geb", "gest", "ggf", "h", "Hr", "hrsg", "i", "inkl", "Jh", "lat", "max", "min", "Mio", "Mrd", "Nr", "o",
    "resp", "s", "sog", "Std", "Str", "Tel", "u", "usw", "vgl", "z", "zzgl",
    # fr
    "apr", "av", "boul", "cf", "chap", "dir", "éd", "env", "ex", "hab", "Mgr", "MM", "Mlle", "Mme", "p", "pp", "tél", "trad", "vol",
    # es
    "Avda", "cap", "Cía", "dcha", "Dra", "Ej", "fig", "izq", "Lic", "máx", "mín", "núm", "pág", "Sra", "Srta", "Ud", "Uds",
]

# Milliseconds of silence before a block of each kind, inside a block, and pace.
GAP_BEFORE = {"heading": 450, "paragraph": 180, "item": 100, "quote": 300, "caption": 300}
SENTENCE_GAP = 120
PACE = {"tight": 0.4, "natural": 1.0, "roomy": 1.8}

# What the sanitiser drops with its subtree, keeps, and lets each element carry.
DROPPED_TAGS = frozenset(
    "script style iframe frame frameset object embed applet form input textarea select option optgroup "
    "button label fieldset legend output progress meter link meta base title head template slot noscript "
    "svg math canvas dialog portal marquee track map area param".split()
)
ALLOWED_TAGS = frozenset(
    "p br hr span div section article main aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre code "
    "kbd samp var em strong i b u s del ins sub sup small mark abbr cite q time address wbr ruby rt rp "
    "details summary figure figcaption img picture source video audio table thead tbody tfoot tr th td "
    "caption colgroup col a".split()
)
GLOBAL_ATTRIBUTES = frozenset("id lang dir title".split())
TAG_ATTRIBUTES = {
    "a": "href", "img": "src alt width height loading decoding", "source": "src type width height",
    "video": "src poster controls width height", "audio": "src controls",
    "td": "colspan rowspan headers abbr", "th": "colspan rowspan headers scope abbr",
    "col": "span", "colgroup": "span", "ol": "start reversed type", "li": "value", "time": "datetime",
    "details": "open", "blockquote": "cite", "q": "cite", "del": "cite datetime", "ins": "cite datetime",
}
URL_ATTRIBUTES = frozenset("href src poster cite".split())
VOID_TAGS = frozenset("br hr img source col wbr input link meta base area param track embed frame".split())


def _quoted(phrase: str) -> str:
    return "".join(c if c.isalnum() or c == " " else rf"\x{{{ord(c):x}}}" for c in phrase)


def _listed(labels: dict[str, list[str]]) -> list[str]:
    return [_quoted(label) for language in labels.values() for label in language]


def furniture_pattern(anywhere: bool = False) -> str:
    """Matches text that begins with a furniture label or only says what someone does for the press.

    `anywhere`, it matches text that holds such words at any place.
    """
    start = r"(?:^|[^\p{L}\p{N}])" if anywhere else "^"
    staff = r"\p{L}[^\s]*(?:\s\p{L}[^\s]*){1,3}\sis\san?\s(?:\p{L}+\s){0,2}(?:" + "|".join(OCCUPATIONS) + ")"
    lone = "(?:" + "|".join(_listed(LONE_LABELS)) + r")[^\p{L}\p{N}]*$"
    return "(?i)" + start + "(?:" + "|".join([*_listed(FURNITURE_LABELS), *FURNITURE_WORDINGS, *FURNITURE_SIGNS, staff, lone]) + r")(?:[^\p{L}\p{N}]|$)"


def wall_pattern() -> str:
    """Matches text that contains a gate label."""
    return "(?i)(?:" + "|".join([*_listed(GATE_LABELS), *GATE_WORDINGS]) + ")"
