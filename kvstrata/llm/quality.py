"""Quality rules, line first: lines that fail are removed, then documents that lose too much are rejected.

Native column expressions, no shuffle. Words are runs of anything but the six ASCII white-space characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.common import let

_SPACE = r"[\x20\x09-\x0D]+"
#: A document with fewer words fails.
MIN_WORDS = 50
#: A document with a larger share (in hundredths) of words in repeated 3-word windows fails.
MAX_REPEATED = 50
#: A document fails if the removed lines held a larger share of its word characters.
MAX_LOST = 0.5
#: A line fails the punctuation rule if a larger share of its word characters are symbols or exclamation marks.
MAX_LINE_SYMBOLS = 0.15
_SYMBOLS = r"[^#*$%&|<>{}\\~^=_!]+"
#: A navigation line is at least two of these separators with at most three words between neighbours on average.
_SEPARATORS = r"(?:\||»|›|>|·|•)"
#: Fixed phrases of boilerplate lines, lower case: English, German, French and Spanish.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "javascript is disabled", "log in to comment",
    "lorem ipsum", "powered by wordpress", "privacy policy", "share on facebook", "share on twitter", "sign up for our newsletter", "skip to content",
    "subscribe to our newsletter", "terms of service", "terms of use", "use cookies",
    "abonnieren sie", "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "auf facebook teilen", "cookies akzeptieren", "datenschutzerklärung", "javascript aktivieren",
    "klicken sie hier", "nutzungsbedingungen", "verwendet cookies", "zum inhalt springen",
    "abonnez-vous", "accepter les cookies", "activer javascript", "aller au contenu", "cliquez ici", "conditions d'utilisation", "mentions légales", "partager sur facebook", "politique de confidentialité",
    "tous droits réservés", "utilise des cookies",
    "aceptar cookies", "activar javascript", "aviso legal", "compartir en facebook", "haga clic aquí", "ir al contenido", "política de privacidad", "suscríbase a", "términos de uso", "todos los derechos reservados",
    "utiliza cookies",
)
#: Fixed entries of menus, lower case; a line of two or more of them and nothing else is navigation.
MENU = (
    "about", "about us", "account", "archive", "blog", "categories", "contact", "contact us", "faq", "help", "home", "imprint", "login", "logout", "menu", "news", "next", "previous", "register", "search", "shop", "sign in", "sitemap",
    "anmelden", "hilfe", "impressum", "kontakt", "startseite", "suche", "über uns", "weiter", "zurück",
    "accueil", "aide", "connexion", "précédent", "recherche", "suivant", "à propos",
    "anterior", "ayuda", "buscar", "contacto", "inicio", "quiénes somos", "siguiente",
)
#: A line that breaks off fails the punctuation rule as well.
_CUT_OFF = r"(?:\.\.\.|…|\[…\]|\[\.\.\.\])[\x20\x09-\x0D]*$"


def _any(words: tuple[str, ...]) -> str:
    """A pattern of any of the words, by their first letters."""
    first = dict.fromkeys(w[0] for w in words)
    return "(?:" + "|".join(c + "(?:" + "|".join(w[1:] for w in words if w[0] == c) + ")" for c in first) + ")"


#: A phrase counts where no letter stands before it.
_PHRASES = r"(?:^|[^a-z\u00df-\u00ff])" + _any(BOILERPLATE)
_MENU = _any(MENU)
_MENU_LINE = rf"^[\x20\x09-\x0D]*{_MENU}(?:[\x20\x09-\x0D]+{_MENU})+[\x20\x09-\x0D]*$"
#: The beginning of such a line in a whole text.
_MENU_START = rf"(?:^|\n)[\x20\x09-\x0D]*{_MENU}[\x20\x09-\x0D]+{_MENU}"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE, -1), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more; windows are compared by 64-bit hashes of three words' hashes."""

    def windows(h: Column) -> Column:
        pair = F.zip_with(F.slice(h, F.lit(1), F.size(h) - 2), F.slice(h, F.lit(2), F.size(h) - 2), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(pair, F.slice(h, F.lit(3), F.size(h) - 2), lambda a, c: F.xxhash64(a, c))

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        same = lambda p, x, at: F.coalesce(F.get(p, at)["g"] == x["g"], F.lit(False))
        repeats = let(placed, lambda p: F.array_sort(F.transform(F.filter(F.transform(p, lambda x, i: F.struct(x["i"].alias("i"), (same(p, x, i - 1) | same(p, x, i + 1)).alias("again"))), lambda x: x["again"]), lambda x: x["i"])))
        # each repeated window adds the words after the end of the repeated window before it
        return let(repeats, lambda r: F.aggregate(r, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"]))

    def by_windows(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), by_windows))


def _cleaned(text: Column) -> Column:
    """The text without the lines that fail. What a text has nowhere is not looked for in its lines."""
    low = F.lower(text)
    has = {
        "symbols": text.rlike(r"[#*$%&|<>{}\\~^=_!»›·•]"),
        "cut_off": text.rlike(r"\.\.\.|…"),
        "menu": low.rlike(_MENU_START),
        "phrase": low.rlike(_PHRASES),
    }

    def fails(line: Column, v: Column) -> Column:
        symbols = F.length(F.regexp_replace(line, _SYMBOLS, ""))
        punctuation = (symbols > 3) & (symbols > MAX_LINE_SYMBOLS * F.length(F.regexp_replace(line, _SPACE, "")))
        parts = F.size(F.split(line, _SEPARATORS, -1))
        navigation = line.rlike(_SEPARATORS + "(?s:.*)" + _SEPARATORS) & (F.size(F.split(F.trim(line), _SPACE, -1)) <= 3 * parts + parts - 1)
        return (v["symbols"] & (punctuation | navigation)) | (v["cut_off"] & line.rlike(_CUT_OFF)) | (v["menu"] & F.lower(line).rlike(_MENU_LINE)) | (v["phrase"] & F.lower(line).rlike(_PHRASES))

    some = lambda v: v["symbols"] | v["cut_off"] | v["menu"] | v["phrase"]
    kept = lambda v: F.array_join(F.filter(F.split(v["text"], "\n", -1), lambda x: ~fails(x, v)), "\n")
    return let(F.struct(text.alias("text"), *[c.alias(k) for k, c in has.items()]), lambda v: F.when(some(v), kept(v)).otherwise(v["text"]))


def measure(docs: DataFrame, ident: str = "doc_id", text: str = "text", *, carry: bool = False) -> DataFrame:
    """Per row: ident, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned.

    A line fails if too many of its characters are symbols, if it breaks off, if it is a menu, or if it holds a phrase of
    BOILERPLATE. ``cleaned`` is the text without failed lines (null for a null text, which has no words and is rejected, as
    is an empty one). Rows stay rows: repeated documents are judged alike. Very long texts are taken whole, and an empty table gives an empty one. With ``carry`` the whole row comes along as the struct ``q_row``; other columns don't matter.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(full, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    solid = lambda c: F.length(F.regexp_replace(c, _SPACE, "")).cast("long")
    measured = docs.select(
        F.col(ident),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_row")] if carry else []),
        F.col(text).alias("q_text"),
        let(_words(full), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("q"),
        solid(full).alias("word_chars"),
        F.length(F.regexp_replace(full, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _cleaned(full).alias("q_cleaned"),
    )
    base_failed = (F.col("q.n") < MIN_WORDS) | (100 * F.col("q.r") > MAX_REPEATED * F.col("q.n"))
    left = F.when(F.length("q_cleaned") == F.length("q_text"), F.col("word_chars")).otherwise(solid(F.col("q_cleaned")))
    lost = F.col("word_chars") - left
    return measured.select(
        ident,
        F.col("q.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("q.r").alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & (lost <= MAX_LOST * F.col("word_chars"))).alias("kept"),
        F.when(F.col("q_text").isNotNull(), F.col("q_cleaned")).alias("cleaned"),
        *(["q_row"] if carry else []),
    )


def clean(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of kept documents, with cleaned texts and their n_chars (if there is such a column)."""
    # a plain filter would be pushed below the measuring and do it twice
    one = F.array(F.struct("kept", "cleaned", "q_row"))
    kept = measure(docs, ident, text, carry=True).select(F.explode_outer(F.filter(one, lambda m: m["kept"])).alias("m")).filter("m IS NOT NULL")
    new = {text: F.col("m.cleaned"), "n_chars": F.length("m.cleaned").cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col("m.q_row").getField(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The numbers and the verdict of every document."""
    return measure(docs).drop("cleaned")
