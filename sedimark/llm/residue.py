"""Template residue and error-page text: character n-gram models, likelihood-ratio windows, exclusion by coverage.

* *Models.* Conditional character n-gram models, interpolated over orders 1 to 5: natural prose, filler, error and access
  messages (with notices that scripts or another browser are needed), and prose about such texts, which is content. The
  probability of a character after k characters is ``(count + m * P)/(count of the k characters + m)``, where ``P`` is
  its probability after k - 1 of them; the residue models end in the prose model instead of a uniform one, so where
  they know nothing the ratio is even. Counts are kept by hash in tables of a fixed size.
* *Training.* The residue models start from the seed phrases below, prose from all windows of all documents. Then, for
  ``rounds`` rounds, the models sort all windows: one whose ratio to prose is positive as a whole goes to the class with
  the best ratio; one that only holds a stretch that is far likelier as residue than as prose belongs to no model; the
  others are prose. So prose forgets the residue that the documents hold, and the residue models learn the collection's
  phrasing. Each distinct window of the collection is sorted once; prose counts it as often as it occurs, the residue
  models once. Counts are whole numbers, added up per task and then as a tree: they do not depend on how rows are dealt.
  Prose weighs its counts to a fixed worth, and the residue models those of each context, so they depend on how often
  something occurs in proportion and not on how large the collection is. Unbroken runs, which no model judges, are not
  counted.
* *Windows.* A text's running part (no fenced code, no inline code) is cut into sentences and lines. A window is residue
  where its log likelihood ratio against prose exceeds ``evidence`` nats, prose where it is below the negative; what
  lies between (headings, menus) is neutral.
* *Coverage.* A document is filler, an error page or a notice when windows of these classes cover at least ``coverage``
  of its characters that are not neutral; code counts as content.
* *Places.* Unfilled template places are a matter of form, of which n-gram models see little: the collection's own prose
  is full of them. They are found by exact patterns in the windows of running text, without a model.

The broadcast models have a fixed size (``BUCKETS`` times the orders and classes), whatever the data.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.session import cut_lineage, drop_table

BUCKETS = 1 << 17
ORDERS = 5
PROSE, FILLER, NOTICE, ABOUT = range(4)
NAMES = ("prose", "filler", "notice", "about")
#: between windows, so that no context reaches into the window before
GAP = ORDERS - 1
_BEGIN = "\x02" * (GAP + 1)
_END = "\x03" + _BEGIN
#: weight of the lower order in prose, and in the residue models
PROSE_MASS, CLASS_MASS = 4.0, 2.0
#: the counts of prose weigh as so many characters at most; all documents are counted, but with weights that grew with
#: the collection, prose would learn each phrase of residue by heart
PROSE_WORTH = 1e6
#: what documents tell of a residue model's context weighs as so many characters at most, so that the commonest kind of
#: residue does not drown the seeds, which come on top
CONTEXT_WORTH = 200.0
#: a longer run of characters without white space is no word but data, which counts as content
LONGEST_WORD = 120
#: a seed phrase weighs as so many windows
SEED_WEIGHT = 3
#: a stretch is suspicious when its log ratio exceeds this and the logarithm of the window's length, by which the best
#: of as many chance stretches grows
SUSPICIOUS = 1.5

#: seed phrases per class, in the languages of the collection (fixed values)
SEEDS: dict[int, list[str]] = {
    ABOUT: [  # sentences about such texts, which are content
        "Access denied errors are logged once per session and counted as failures.", "A missing file must answer 404 Not Found with an empty body, and the client retries nothing.", "We replaced the notice by a server-rendered table.", "Scripts and cookies are blocked in the kiosk, therefore the page renders on the server.",
        "The fixture uses lorem ipsum paragraphs on purpose, so the snippets never match real queries.", "During the outage the proxy answered 502 Bad Gateway and the engineer drained the pool.", "The handler returns 500 when the upstream service does not answer in time, and the caller tries again later.", "Requests above the limit get 429 Too Many Requests; we raised the limit for the import job.",
        "The browser test checks that the page works without JavaScript.", "The audit lists every TODO; most of them are older than a year.", "The template shows the user's name; bind the field again.", "The placeholder text in the mock-up was replaced before the release.", "Expired sessions are closed by a job every night.", "The error page was moved to the static folder, because the service may be down when it is needed.",
        "El servidor devuelve 404 cuando falta el archivo y el cliente no reintenta.", "La plantilla muestra el nombre porque falta el enlace.", "Los errores de acceso denegado se registran una vez por sesión.", "El aviso de JavaScript se quitó de la página.",
        "Le serveur répond 404 quand le fichier manque, sans nouvel essai.", "Le gabarit affiche le nom car la liaison manque.", "Les erreurs d'accès refusé sont journalisées une fois par session.", "L'avis sur JavaScript a été retiré de la page.",
        "Der Server antwortet mit 404, wenn die Datei fehlt.", "Die Vorlage zeigt den Namen, weil die Bindung fehlt.", "Fehler beim Zugriff werden einmal je Sitzung protokolliert.", "Der Hinweis auf JavaScript wurde von der Seite entfernt.",
    ],
    FILLER: [
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
        "Praesent vestibulum morbi felis integer aptent taciti sociosqu ad litora torquent per conubia nostra. Curabitur velit magnis ornare tempus blandit aliquam nostra curabitur lorem ipsum magna praesent dolor integer.",
        "Sample text.", "Placeholder text.", "This is placeholder text.", "Text goes here.", "Your text goes here.", "Copy to come.",
        "TBD", "TBA", "TODO", "to be written", "to be supplied", "Content coming soon.", "Coming soon.", "Check back later for this section.", "Under construction.", "This page is under construction.", "Dummy text.", "Insert text here.",
        "asdf jkl asdf jkl", "asdf asdf", "jkl jkl jkl", "hjkl hjkl asdf asdf asdf", "xxxxx xxxxx", "xxxxx xxxxx xxxxx", "test test 1 test test", "test test test", "xxx xxx xxx xxx", "foo bar baz foo bar", "qwerty qwerty", "blah blah blah", "aaa bbb ccc",
        "Texto de relleno.", "Texto de ejemplo.", "Aquí va el texto.", "Próximamente.", "Contenido próximamente.", "Página en construcción.",
        "Texte de remplissage.", "Contenu à venir.", "Le texte vient ici.", "Page en construction.", "Bientôt disponible.",
        "Blindtext.", "Platzhaltertext.", "Hier steht später Text.", "Hier kommt der Text hin.", "Inhalt folgt.", "Seite im Aufbau.", "Beispieltext.",
        "Nullam quis risus eget urna mollis ornare vel eu leo. Cum sociis natoque penatibus et magnis dis parturient montes, nascetur ridiculus mus. Donec ullamcorper nulla non metus auctor fringilla. Vestibulum id ligula porta felis euismod semper. Praesent commodo cursus magna, vel scelerisque nisl consectetur et. Aenean lacinia bibendum nulla sed consectetur. Maecenas faucibus mollis interdum. Integer posuere erat a ante venenatis dapibus posuere velit aliquet. Morbi leo risus, porta ac consectetur ac, vestibulum at eros.", "Cras mattis consectetur purus sit amet fermentum. Etiam porta sem malesuada magna mollis euismod. Sed posuere consectetur est at lobortis. Fusce dapibus, tellus ac cursus commodo, tortor mauris condimentum nibh, ut fermentum massa justo sit amet risus. Curabitur blandit tempus porttitor. Duis mollis, est non commodo luctus, nisi erat porttitor ligula, eget lacinia odio sem nec elit. Class aptent taciti sociosqu ad litora torquent per conubia nostra, per inceptos himenaeos. Quisque viverra ipsum quaerat voluptatem erosque rudis. Aliquam erat volutpat, nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.", "test test test test", "qwer qwer asdf zxcv", "lkj lkj fdsa fdsa", "This paragraph is only a placeholder.", "Placeholder paragraph.", "Placeholder heading for the section.", "Real content will be added later.", "The final text will follow.", "Headline", "Subheading two", "Heading three", "Copy will be provided.", "Dummy copy. Dummy copy.", "Example text. Example text.", "n/a n/a n/a", "El texto definitivo vendrá después.", "Texto provisional.", "Le texte définitif suivra.", "Texte factice.", "Der endgültige Text folgt später.", "Mustertext.",
    ],
    NOTICE: [
        "404 Not Found", "The requested page was not found on this server.", "Go back to the home page or search for it.", "The resource has been moved or deleted (404).", "Page not found", "This page does not exist.", "The link to this document has expired or the document has been removed by its owner.", "This link has expired.", "The content you requested is no longer available.", "This document has been removed or is private.",
        "500 Internal Server Error", "Internal Server Error", "Something went wrong on our side while loading the page.", "We're sorry, the service is currently experiencing problems.", "An unexpected error occurred.", "Please try again later.", "Oops! Something went wrong.",
        "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout", "The upstream service did not answer in time.", "The server is temporarily unable to service your request.", "Service temporarily unavailable.", "Error 503: no healthy backend for the service", "The connection has timed out.", "Request timed out.",
        "403 Forbidden", "Access denied", "You do not have permission to open this page.", "You are not authorized to view this page.", "401 Unauthorized", "Sign in to continue.", "Your session has expired, please sign in again.", "Log in to view this content.",
        "429 Too Many Requests", "Too many requests.", "You have been rate limited; retry in a few seconds.", "Request blocked. Reference number 123.",
        "Traceback (most recent call last):", 'File "app.py", line 10, in render', "TypeError: undefined is not a function", "java.lang.NullPointerException at com.example.Main.run(Main.java:10)", "Fatal error: Uncaught exception in index.php on line 3", "Warning: mysql_connect() failed in db.php on line 9",
        '{"status": 500, "error": "upstream_failure", "path": "/page", "message": "no body"}', '{"error": "not_found", "code": 404, "message": "no such page"}', "<html><head><title>503 Service Unavailable</title></head><body><h1>the page is down</h1><hr></body></html>", "<html><head><title>404 Not Found</title></head><body><center><h1>404 Not Found</h1></center><hr></body></html>",
        "Please enable JavaScript to view this page.", "You need to enable JavaScript to run this app.", "JavaScript is disabled.", "The viewer does not work without it.", "This site requires JavaScript.", "Your browser is not supported.", "Activate scripting or switch browsers to open the page.", "Please upgrade your browser.", "Checking your browser before opening the page...", "Cookies must be enabled.", "Loading...", "Loading the page...", "Please turn on scripts and reload.", "Verify you are human.",
        "Esta aplicación necesita scripts para funcionar; habilítelos y recargue.", "Active JavaScript para ver la página.", "Su navegador no es compatible.", "La página solicitada no existe o se ha movido.", "Se ha producido un error interno al cargar la página.", "Su sesión ha caducado, vuelva a identificarse para abrir la página.", "Acceso denegado.", "No tiene permiso para ver esta página.", "No tiene permisos para ver este documento.", "El enlace ha caducado o el documento ha sido eliminado.", "Error 404: página no encontrada", "Demasiadas solicitudes.",
        "Activez JavaScript pour afficher la page.", "Cette application a besoin de scripts pour fonctionner.", "Votre navigateur n'est pas pris en charge.", "La page demandée est introuvable.", "La page demandée n'existe pas ou a été déplacée.", "Une erreur interne s'est produite lors du chargement de la page.", "Veuillez réessayer plus tard.", "Votre session a expiré, veuillez vous reconnecter.", "Accès refusé.", "Le lien a expiré ou le document a été supprimé.", "Vous n'avez pas la permission de voir cette page.", "Service indisponible.", "Trop de requêtes.", "Vous n'avez pas les droits pour ouvrir cette page.",
        "Bitte aktivieren Sie JavaScript, um die Seite anzuzeigen.", "Ihr Browser wird nicht unterstützt.", "Die angeforderte Seite wurde nicht gefunden.", "Die Seite existiert nicht oder wurde verschoben.", "Beim Laden der Seite ist ein interner Fehler aufgetreten.", "Bitte versuchen Sie es später erneut.", "Ihre Sitzung ist abgelaufen, bitte melden Sie sich erneut an.", "Zugriff verweigert.", "Der Link ist abgelaufen oder das Dokument wurde entfernt.", "Der Dienst ist vorübergehend nicht verfügbar.", "Zu viele Anfragen.", "Sie haben keine Berechtigung für diese Seite.",
        "Sorry, this page could not be found.", "Oops! That page can't be found.", "We could not find the page that you were looking for.", "Search for what you need or return to the home page.", "The server encountered an internal error and was unable to complete your request.", "HTTP Error 404. The requested resource is not found.", "Your access to this site has been limited.", "Forbidden: you don't have permission to access this resource.", "This service is down for scheduled maintenance. We will be back shortly.", "The site is temporarily unavailable.", "Error reference: 1234abcd", "Incident id: 99ff00aa", "JavaScript must be enabled in order for you to use this application.", "This application requires JavaScript. Turn it on in the settings of your browser and reload.", "We use scripts to show this page; please switch to a supported browser.", "Just a moment...", "Verifying your browser. This can take some seconds.", "Slow down: you made too many requests, wait before trying again.", "The request could not be satisfied. Contact the administrator if this continues.", "You must be logged in to see this page.", "The file has been deleted by its owner or the link is no longer valid.", "Your link is invalid or has expired.", "No se ha encontrado la página.", "El servicio no está disponible en este momento; vuelva a intentarlo más tarde.", "Se requiere JavaScript para usar esta aplicación.", "Acceso prohibido: no está autorizado.", "Page introuvable.", "Le serveur a rencontré une erreur, réessayez dans quelques minutes.", "Le service est momentanément indisponible.", "JavaScript est requis pour utiliser cette application.", "Accès interdit: vous n'êtes pas autorisé.", "Seite nicht gefunden.", "Auf dem Server ist ein Fehler aufgetreten, versuchen Sie es in einigen Minuten noch einmal.", "JavaScript ist erforderlich, um diese Anwendung zu nutzen.", "Zugriff nicht erlaubt: Sie sind nicht berechtigt.",
    ],
}

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*\r?$|\Z)", re.S | re.M)
_INLINE = re.compile(r"``[^`]+``|`[^`\n]*`")
_QUOTED = re.compile(r"\"[^\"\n]{1,160}\"|“[^”\n]{1,160}”|«[^»\n]{1,160}»|„[^“”\n]{1,160}[“”]")
_CODE_LINE = re.compile(r"^(?: {4}|\t)\S|[;{]\s*$|^\s*(?:const|let|var|import|export|return|def|class|if|for|while|function|await|print|echo|curl|\$ |> ?\$)\b.*[=({;:]|=>|\)\s*:\s*$|^\s*[\w.\[\]]+\s*[-+*/]?=\s*\S|^\s*</?[a-z][^>]*>")
_PLACE = re.compile(
    r"\{\{[-\s]*[\w.\- |]{1,60}[-\s]*\}\}|<%[=-]?\s*[\w.\- ]{1,60}\s*%>|\$\{[A-Za-z_][\w.\-]{0,60}\}|(?<![\w$\])}])\{[A-Za-z][a-z0-9]*(?:[_.\- ][A-Za-z0-9]+)*\}(?![\w(\[{])|%[A-Z][A-Z0-9_]{2,}%|%\([a-z_]+\)s"
    r"|@@[A-Za-z][\w-]*@@|(?<!\w)__[A-Z][A-Z0-9_]{2,}__(?!\w)|(?<![\w$])\$[A-Z][A-Z0-9]*_[A-Z0-9_]+\b|(?<![\w$])\$(?:NAME|DATE|TITLE|AUTHOR|EMAIL|VERSION|USER|COMPANY)\b"
    r"|\[\[\s*[A-Z][A-Z_ ]{2,}[^\]\n]{0,60}\]\]"
    r"|\[(?!x\]| \])(?:[^\]\n]{0,60}\b)?(?i:your|insert|enter|fill in|fill|todo|tbd|tbc|add|describe|description|placeholder|title|section|name|date|link|e-?mail|company|here|insertar|nombre|título|titulo|fecha|descripci[oó]n|rellenar|completar|a[ñn]adir|ins[ée]rer|votre|nom|titre|compl[ée]ter|remplir|ajouter|einf[üu]gen|eintragen|ausf[üu]llen|erg[äa]nzen|hier|titel|datum)\b[^\]\n]{0,60}\](?![(\[:])"
    r"|<(?:[A-Z][A-Z0-9]*(?:[ _-][A-Z0-9]+)*|(?i:describe|insert|enter|your|add|name of|title of|list|fill|replace|short|one|beschreib\w*|descri\w+|nom|nombre|votre|su|ihr)\b[^<>\n/]{2,70})>"
    r"|\b(?:YYYY|AAAA|JJJJ)[-/.](?:MM)[-/.](?:DD|JJ|TT)\b|\b(?:DD|JJ|TT|MM)[-/.](?:MM|DD|JJ|TT)[-/.](?:YYYY|AAAA|JJJJ|YY|AA)\b|(?<![\w-])X{3,}(?![\w-])|(?<=: )_{3,}|(?<=: )\.{4,}"
)
#: what every place of these holds; looked for first, since it is cheap
_MARK = re.compile(r"[\[{<$%@]|__|XXX|[-/.](?:MM|DD|JJ|TT|YY|AA)|: \.{4}")
_TO_WRITE = re.compile(r"^\W*(?:replace|substitute) this (?:paragraph|text|section|line|sentence)\b|^\W*(?:sustituya|reemplace|sustituir) est[ea] (?:texto|p[áa]rrafo|secci[óo]n)\b|^\W*remplace[zr] (?:ce|cette) (?:texte|paragraphe|section)\b|^\W*ersetzen sie (?:diesen|diese) (?:text|absatz|abschnitt)\b", re.I)
_FIELD = re.compile(r"^\W*[A-ZÀ-Ý][\w ]{1,30} ?:\s*(?:TBD|TBC|TBA|TODO|\?\?\?+)\W*$", re.M)
_MIXED_CASE_TAG = frozenset("EOF EOT EOL NULL NUL DOCTYPE CDATA".split())


_CUT = re.compile(r"\n|(?<=[.!?…])[^\S\n]+(?=[^\sa-z])")
_DIGIT = re.compile(r"\d")


def running(text: str) -> str:
    """The text without fenced and inline code. An unclosed fence holds the rest."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    return _INLINE.sub(" ␟ ", text) if "`" in text else text


def _cut(text: str) -> list[str]:
    """Sentences and lines of running text. A sentence ends at a mark before white space."""
    return [w for w in map(str.strip, _CUT.split(text)) if w]


def _is_data(window: str) -> bool:
    return len(window) > LONGEST_WORD and " " not in window


def _plain(window: str) -> str:
    """With one digit and one blank."""
    return " ".join(_DIGIT.sub("0", window).split())


def windows(text: str) -> list[str]:
    return [_plain(w) for w in _cut(text)]


def _tally(texts: list[str | None]) -> Counter:
    """How often each window occurs in the texts. Data are left out: no model judges them, and their n-grams never end."""
    raw = Counter(w for t in texts if t for w in _cut(running(t)))
    out: Counter = Counter()
    for w, n in raw.items():
        if not _is_data(plain := _plain(w)):
            out[plain] += n
    return out


# -- models ------------------------------------------------------------------------------------------------------------


def _parts(texts: list[str], chars: int = 60_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``chars`` characters, which a processor's cache can hold; a longer text is its own."""
    at = size = 0
    for i, t in enumerate(texts, 1):
        size += len(t)
        if size >= chars:
            yield at, i
            at, size = i, 0
    if at < len(texts):
        yield at, len(texts)


def _lay(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in lower case end to end as code points, with the start and length of each."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer((_BEGIN + "".join(t + _END for t in low)).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    n = np.array([len(t) for t in low], dtype=np.int64)
    return codes, len(_BEGIN) + np.concatenate([[0], np.cumsum(n + len(_END))[:-1]]).astype(np.int64), n


def _hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of every character with its context."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for k in range(ORDERS):
        shifted = np.concatenate([np.full(k, 2, dtype=np.uint64), codes[: len(codes) - k]])
        h = h * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(1)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield ((mixed >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def count(texts: list[str], weights: np.ndarray | None = None) -> np.ndarray:
    """How often each bucket of each order occurs in the texts; begin and end of a text count as characters."""
    total = np.zeros((ORDERS, BUCKETS), dtype=np.int64)
    for a, b in _parts(texts):
        codes, starts, n = _lay(texts[a:b])
        own = np.ones(b - a) if weights is None else weights[a:b].astype(np.float64)
        steps = np.zeros(len(codes) + 1)
        np.add.at(steps, starts - 1, own)
        np.add.at(steps, starts + n + 1, -own)
        weight = np.rint(np.cumsum(steps)[:-1])
        for order, buckets in enumerate(_hashes(codes)):
            total[order] += np.bincount(buckets, weights=weight, minlength=BUCKETS).astype(np.int64)
    return total


class Models:
    """Log likelihood ratios of windows under the residue models against prose."""

    def __init__(self, counts: np.ndarray) -> None:
        """``counts``: whole numbers by class, order and bucket, of the windows of documents; the seeds are added."""
        self.counts = counts
        weighed = np.zeros((ORDERS, BUCKETS, 2 * len(NAMES) - 1), dtype=np.float32)  # the classes, and the seeds of all but prose
        weighed[:, :, : len(NAMES)] = np.moveaxis(counts, 0, 2)
        weighed[:, :, PROSE] = counts[PROSE] * min(1.0, PROSE_WORTH / max(int(counts[PROSE, 0].sum()), 1))
        for kind, ws in _SEEDS.items():
            weighed[:, :, len(NAMES) - 1 + kind] = SEED_WEIGHT * count(ws)
        self.logs = weighed  # order, bucket, class
        self.total = weighed[0].sum(axis=0, dtype=np.float64).astype(np.float32)

    def _chars(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per part the ratios of every character under filler, notice and about, and the start and length of each text."""
        lower, upper, worth = np.float32(CLASS_MASS), np.float32(PROSE_MASS), np.float32(CONTEXT_WORTH)
        for a, b in _parts(texts):
            codes, starts, n = _lay(texts[a:b])
            prose = np.full(len(codes), 1 / 65536, dtype=np.float32)
            steps = []
            before = None
            for order, buckets in enumerate(_hashes(codes)):
                own = self.logs[order].take(buckets, axis=0)
                context = np.broadcast_to(self.total, own.shape) if before is None else np.concatenate([np.zeros((1, own.shape[1]), np.float32), before[:-1]])
                np.minimum(own, context, out=own)  # only buckets that n-grams share exceed their context
                prose = (own[:, PROSE] + upper * prose) / (context[:, PROSE] + upper)
                known = context[:, 1 : len(NAMES)]
                share = own[:, 1 : len(NAMES)] * (worth / np.maximum(known, worth))
                steps.append((share + own[:, len(NAMES) :], np.minimum(known, worth) + context[:, len(NAMES) :]))
                before = own
            np.maximum(prose, np.float32(1e-20), out=prose)  # no ratio depends on it, and no product of what follows is zero
            p = np.repeat(prose[:, None], len(NAMES) - 1, axis=1)
            for own, context in steps:
                p *= lower
                p += own
                p /= context + lower
            p /= prose[:, None]
            yield np.log(p, out=p), starts, n

    def ratios(self, texts: list[str]) -> np.ndarray:
        """For each text the mean log likelihood ratio per character under filler, notice and about."""
        return self.measure(texts, False)[0]

    def measure(self, texts: list[str], stretches: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`ratios`, and the ratio of the best stretch of each text."""
        means, best = [], []
        for chars, starts, n in self._chars(texts):
            sums = np.zeros((len(chars) + 1, chars.shape[1]))
            np.cumsum(chars, axis=0, out=sums[1:], dtype=np.float64)
            means.append((sums[starts + n + 1] - sums[starts]) / (n + 1)[:, None])
            if not stretches:
                continue
            # the least sum so far, text by text: every text lies far below the one before
            steps = np.zeros(len(chars) + 1)
            np.add.at(steps, starts, 1)
            inside = np.zeros(len(chars) + 1)
            np.add.at(inside, starts, 1)
            np.add.at(inside, starts + n, -1)
            drop = np.cumsum(steps)[:-1, None] * 1e5
            least = np.minimum.accumulate(sums[:-1] - drop, axis=0) + drop
            rise = np.where((np.cumsum(inside)[:-1] > 0)[:, None], sums[1:] - least, -np.inf)
            best.append(np.maximum.reduceat(rise, starts, axis=0))
        none = np.zeros((0, len(NAMES) - 1))
        return (np.concatenate(means) if means else none), (np.concatenate(best) if best else none)


_SEEDS = {kind: windows("\n".join(phrases)) for kind, phrases in SEEDS.items()}
_LABELLED = {w.lower(): kind for kind, ws in _SEEDS.items() for w in ws}


def deal(flat: list[str], models: Models | None) -> np.ndarray:
    """The class of each window: prose, one of the others, or -1 for none. All are prose without models, but the seeds."""
    kinds = np.full(len(flat), PROSE)
    if models is not None and flat:
        means, best = models.measure(flat)
        suspicious = best[:, :2].max(axis=1)
        length = np.log(np.array([len(w) for w in flat]) + 1.0)
        kinds[(suspicious > SUSPICIOUS + length) & (suspicious > best[:, 2])] = -1
        kinds = np.where(means.max(axis=1) > 0, means.argmax(axis=1) + 1, kinds)
    for i, w in enumerate(flat):
        if len(w) < 400 and (own := _LABELLED.get(w.lower())) is not None:
            kinds[i] = own if models is not None else -1
    return kinds


def counted(flat: list[str], times: np.ndarray, models: Models | None) -> np.ndarray:
    """The counts that some distinct windows add to each class; ``times``: how often each occurs."""
    kinds = deal(flat, models)
    out = np.zeros((len(NAMES), ORDERS, BUCKETS), dtype=np.int64)
    for kind in range(len(NAMES)):
        own = np.flatnonzero(kinds == kind)
        if len(own):
            out[kind] = count([flat[i] for i in own], times[own] if kind == PROSE else None)
    return out


def train(texts: list[str | None], rounds: int = 3) -> Models:
    """Models from the seeds and some whole texts (:func:`train_table` on one machine)."""
    found = _tally(texts)
    flat, times = list(found), np.array(list(found.values()), dtype=np.int64)
    models = None
    for _ in range(rounds + 1):
        models = Models(counted(flat, times, models))
    return models


def train_table(rows: DataFrame, text: str = "_text", rounds: int = 3) -> Models:
    """Models from the seeds and all texts of a table; the same as :func:`train` on all its texts.

    One pass over the texts gives their windows, each with its number; the rounds read that table alone.
    """
    context = rows.sparkSession.sparkContext

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _slices(batch.column(0)):
                found = _tally(texts)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["w", "n"])

    each = cut_lineage(rows.select(text).mapInArrow(cut, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))
    models: Models | None = None
    for _ in range(rounds + 1):
        shared = context.broadcast(_packed(models.counts) if models else None)

        def dealt(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = None if shared.value is None else Models(_unpacked(shared.value))
            total = np.zeros(_SHAPE, dtype=np.int64)
            for batch in batches:
                total += counted(batch.column(0).to_pylist(), batch.column(1).to_numpy(), own)
            yield pa.RecordBatch.from_arrays([pa.array([_packed(total)], pa.binary())], ["counts"])

        parts = each.mapInArrow(dealt, "counts binary")
        for width in (16, 1):  # as a tree, so that one sum arrives at the driver
            parts = parts.repartition(width).mapInArrow(_sum, "counts binary")
        models = Models(_unpacked(parts.first()[0]))
        shared.destroy()
    drop_table(each)
    return models


_SHAPE = (len(NAMES), ORDERS, BUCKETS)


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.int64).reshape(_SHAPE)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SHAPE, dtype=np.int64)
    for batch in batches:
        for data in batch.column(0):
            total += _unpacked(data.as_py())
    yield pa.RecordBatch.from_arrays([pa.array([_packed(total)], pa.binary())], ["counts"])


def _slices(column: pa.Array, chars: int = 8_000_000) -> Iterator[list[str | None]]:
    """The texts of a batch in runs of about ``chars`` characters."""
    part: list[str | None] = []
    size = 0
    for t in column:
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


# -- places ------------------------------------------------------------------------------------------------------------


def places(text: str) -> list[str]:
    """The unfilled places of running text: spans for a person or program to complete. Quoted text and code lines hold none."""
    out = []
    for line in text.split("\n"):
        if not _MARK.search(line) and not _TO_WRITE.match(line) and not _FIELD.match(line):
            continue
        if not line.strip() or _CODE_LINE.search(line) and not re.match(r"\s*(?:<%|\{\{|\[|#)", line):
            continue
        bare = _QUOTED.sub(" ", line)
        for m in _PLACE.finditer(bare):
            span = m.group()
            if span[0] == "<" and span[-1] == ">" and span[1:-1] in _MIXED_CASE_TAG:
                continue
            out.append(span)
        if _TO_WRITE.search(bare):
            out.append(bare.strip())
        out += [m.group().strip() for m in _FIELD.finditer(bare)]
    return out


# -- the operator ------------------------------------------------------------------------------------------------------


def judge(texts: list[str | None], models: Models, coverage: float = 0.5, evidence: float = 24.0) -> list[tuple[str | None, float, int]]:
    """(kind or None, coverage by residue, number of places) of each text. Null, empty and blank texts are no case.

    Equal windows of the texts are judged once.
    """
    bare = [running(t) if t else "" for t in texts]
    cut = [_cut(t) for t in bare]
    raw: dict[str, int] = {}
    index: dict[str, int] = {}
    at = np.array([raw.setdefault(w, len(raw)) for ws in cut for w in ws], dtype=np.int64)
    at = np.array([index.setdefault(_plain(w), len(index)) for w in raw], dtype=np.int64)[at]
    distinct = list(index)
    own = models.ratios(distinct)
    size = np.array([len(w) + 1 for w in distinct], dtype=np.float64)
    worst = own[:, [FILLER - 1, NOTICE - 1]].max(axis=1) if len(own) else np.zeros(0)
    about = own[:, ABOUT - 1] if len(own) else np.zeros(0)
    data = np.array([_is_data(w) for w in distinct], dtype=bool)
    bad = (worst > about) & (worst * size > evidence) & ~data
    prose = data | (np.minimum(worst, np.where(about > worst, -about, worst)) * size < -evidence)
    n_places = np.array([len(places(w)) for w in distinct], dtype=np.int64)
    filler = np.where(own[:, FILLER - 1] > own[:, NOTICE - 1], size, -size) * bad if len(own) else np.zeros(0)
    ends = np.cumsum([len(ws) for ws in cut])
    add = lambda x: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x[at])])[ends]])) if len(cut) else []
    out = []
    for text, rest, residue, content, found, lean in zip(texts, bare, add(size * bad), add(size * prose), add(n_places), add(filler)):
        share = float(residue / (residue + content + len(text or "") - len(rest))) if residue else 0.0  # code is content
        kind = "template" if found else None if not residue or share < coverage else "filler" if lean > 0 else "notice"
        out.append((kind, share, int(found)))
    return out


def find_residue(documents: DataFrame, key: str = "doc_id", text: str = "text", coverage: float = 0.5) -> DataFrame:
    """``key, kind, share, n_places`` of the documents that hold residue: kind template, filler or notice.

    Null, empty and blank texts are no case; whole texts are read; repeated rows come out as often as they are there.
    """
    spark = documents.sparkSession
    t = F.col(f"`{text}`")
    rows = documents.select(F.col(f"`{key}`").alias("_key"), t.alias("_text")).where(t.isNotNull() & (F.length(F.trim(t)) > 0))
    shared = spark.sparkContext.broadcast(_packed(train_table(rows).counts))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = None
        for batch in batches:
            models = models or Models(_unpacked(shared.value))
            at = 0
            for texts in _slices(batch.column(1)):
                keys = batch.column(0).slice(at, len(texts))
                at += len(texts)
                judged = judge(texts, models, coverage)
                keep = [i for i, j in enumerate(judged) if j[0]]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(keep, pa.int64())), pa.array([judged[i][0] for i in keep], pa.string()), pa.array([judged[i][1] for i in keep], pa.float64()), pa.array([judged[i][2] for i in keep], pa.int32())],
                    [key, "kind", "share", "n_places"],
                )

    return rows.mapInArrow(run, f"`{key}` {kind}, kind string, share double, n_places int")
