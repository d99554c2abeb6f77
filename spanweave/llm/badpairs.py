"""Problem 3: flag broken question and answer pairs with their defect.

Method. A multi-label linear classifier over hashed word n-grams of the whole answer (those of its head and tail
once more, marked by position; names, marks and code blocks masked) and features of the pair: how often the question
stands in the answer and how many words remain, what the end of the answer looks like, which languages the two are in,
how long the answer is. No phrase list is looked up when pairs are judged: refusals are found by n-grams and length.

Its training rows are made from the corpus itself: a bounded sample of turns that pass a screen on pair features serves
as sound pairs, and defects are made from them: answers cut off inside a sentence or a code block, questions copied
with variations, answers swapped with ones in another language, refusals composed from phrases, and answers that quote
such phrases and still say something (sound). The model is fitted twice: sampled turns that the first fit takes for
refusals are no sound pairs of the second. Each defect's threshold is calibrated on held-out made pairs. The defect with
the largest margin over its threshold is reported.

The sample bound is the parameter `sample_turns`; every turn is scored, by a narrow map with the small model in its
closure. The n-grams of an Arrow batch are hashed and weighed in one pass over all its tokens.

Defined cases: a null history, a null turn entry or an empty history gives no row; a null or invisible answer is
`empty`; a null question has no language and no words, so it can be neither copied nor answered in a wrong
language; repeated rows of a conversation count once.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.markup import turns

DEFECTS = ("empty", "truncated", "refusal", "copied_question", "wrong_language")
#: Rows of the training sample; buckets of each of the two n-gram hashes.
SAMPLE_TURNS, BUCKETS = 3000, 2048
#: The decay of the named features' weights is this share of that of the n-grams', which are many and noisy.
NAMED_DECAY = 0.003
#: Sound pairs that defects are made from, at least; a smaller sample is gone through several times.
LEAST_PAIRS = 1500
#: Logit of a refusal from which a sampled turn is left out of the sound pairs.
NEAR = -3.0

#: Frequent function words of the languages told apart by words (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is a an for that it on with as are was be this by from or which at not no how what why who does do where can i if into before after its their they then than but never only most every when between has have had will would should could our your you my me any all there these those out up about please explain list",
    "de": "der die das und ist nicht mit von zu den dem des ein eine einer eines einem einen im in auf für sich aus bei nach wie was warum wer wo kann ich wird werden wurde auch es an als durch über unter wenn oder nur noch mehr muss sie wir ihr ihre bitte dass bevor ob weil keinen bereits davon dabei leider diese dieser welche welchen rufen macht",
    "fr": "le la les de des du et est un une dans pour que qui il elle ne pas par sur avec ce cette ces sont au aux se en comment pourquoi quelles quels quelle quel fait puis je vous nous lit après avant dont même si sinon sans plus doit être dès où ou mais cela ainsi son sa ses leur notre votre déjà quand",
    "es": "el la los las de del y es un una en para que por con no se al lo su sus como más qué quién cómo por qué cuando donde dónde este esta estos está son hace puedo debería después antes si ya sin primero porque demasiado cuyo cada también según tras falla funciones llaman todavía conviene obliga",
    "it": "il lo gli della dello degli che di è una un per con non sono come perché dopo prima questa questo nel nella alla dal più quando anche essere ogni dove quale chi",
    "pt": "o os as da do dos das que é uma um para com não são como porque depois antes esta este na no nas nos mais quando também ser cada onde qual quem você",
}
WORDS_OF = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
#: Letters that point to one language (fixed values).
LETTERS = {"de": "ßäöü", "fr": "êèàùâîôûëœç", "es": "ñáíóú", "pt": "ãõ"}
SCRIPTS = (("ja", r"[\u3040-\u30ff]"), ("zh", r"[\u4e00-\u9fff]"), ("ru", r"[\u0400-\u04ff]"), ("el", r"[\u0370-\u03ff]"), ("ko", r"[\uac00-\ud7af]"), ("ar", r"[\u0600-\u06ff]"), ("he", r"[\u0590-\u05ff]"), ("hi", r"[\u0900-\u097f]"))
#: Names of languages in the languages of the questions (fixed values).
LANGUAGE_NAMES = {
    "en": "english englisch englische englischer englischen anglais anglaise inglés inglesa ingles", "de": "german deutsch deutsche deutscher deutschen allemand allemande alemán alemana aleman",
    "fr": "french französisch französische französischen français française francés francesa frances", "es": "spanish spanisch spanische spanischen espagnol espagnole español española espanol castellano",
    "ru": "russian russisch russische russischen russe ruso rusa", "ja": "japanese japanisch japanische japanischen japonais japonaise japonés japonesa japones",
    "el": "greek griechisch griechische griechischen grec grecque griego griega", "it": "italian italienisch italien italienne italiano italiana", "pt": "portuguese portugiesisch portugais portugués portuguesa",
    "zh": "chinese mandarin chinesisch chinois chinoise chino", "ko": "korean koreanisch coréen coreano", "ar": "arabic arabisch arabe árabe",
}
NAMED = {n: k for k, v in LANGUAGE_NAMES.items() for n in v.split()}

#: Of thresholds whose F1 on held-out pairs is this close to the best, the one nearest to even odds is taken.
SLACK = 0.004

#: Phrases that refusals are composed of (fixed values): openings, refusals proper, closings. {q} is a topic.
REFUSALS = {
    "en": (
        ["Sorry,", "I'm sorry, but", "Unfortunately,", "I apologize, but", "As an AI model,", "As an assistant,", "I'm afraid", "Thank you for asking about {q}. However,", "I understand that {q} matters to you. Still,", "This is an interesting matter; still,", "Thanks for the question, but", "", "I regret that"],
        ["I can't help with that request.", "I cannot comply with this.", "I am unable to assist with {q}.", "I am not able to answer this question.", "I won't be able to provide that.", "I must decline to discuss {q}.", "I'd rather not answer that.", "that lies outside what I'm permitted to do.", "it goes against my guidelines, so there will be no answer from me.", "I have been told not to talk about {q}.", "nothing about {q} may be disclosed by me.", "giving you this information is not possible for me.", "answering it is something I have to decline.", "I refuse to answer this.", "I don't feel comfortable answering that.", "I am not allowed to share this.", "this is not something I can talk about.", "it would not be appropriate for me to respond here.", "I have to refrain from commenting on {q}.", "I must pass on this one.", "there is nothing I may say about {q}.", "I am prohibited from discussing {q}.", "this topic is off limits for me."],
        ["", "", "Thank you for your understanding.", "Please ask somebody on your team.", "Feel free to ask about something else!", "Is there another topic you would like to look at?", "Please consult another person.", "I hope you understand.", "Let me know if I can help with anything else."],
    ),
    "de": (
        ["Es tut mir leid, aber", "Leider", "Leider gilt:", "Danke für die Frage.", "Ich bedaure, aber", "Als Assistent gilt:", "", "Entschuldigung,"],
        ["dabei kann ich nicht helfen.", "ich kann diese Frage nicht beantworten.", "eine Antwort darauf muss ich ablehnen.", "über {q} darf ich nicht sprechen.", "diese Auskunft ist mir nicht erlaubt.", "das kann ich nicht tun.", "ich darf dazu nichts sagen.", "dazu gebe ich keine Auskunft.", "das liegt außerhalb dessen, was ich darf.", "es wäre nicht angemessen, hier zu antworten.", "davon muss ich absehen.", "zu {q} möchte ich mich nicht äußern.", "darüber zu sprechen, ist mir nicht gestattet.", "eine Auskunft dazu ist mir nicht möglich.", "diese Antwort muss ich verweigern."],
        ["", "", "Ich bitte um Verständnis.", "Bitte wenden Sie sich an Ihr Team.", "Vielen Dank für Ihr Verständnis.", "Fragen Sie gern etwas anderes."],
    ),
    "fr": (
        ["Désolé, mais", "Je suis désolé, mais", "Malheureusement,", "Merci pour cette question.", "Je regrette, mais", "En tant qu'assistant,", ""],
        ["je ne peux pas répondre à cette demande.", "je dois refuser de donner cette information.", "il m'est impossible de vous aider au sujet de {q}.", "parler de {q} ne m'est pas permis.", "je ne suis pas en mesure de vous aider.", "je ne suis pas autorisé à répondre à cette question.", "cela sort de ce que je peux faire.", "je préfère ne pas répondre.", "il ne serait pas approprié de répondre ici.", "je dois m'abstenir de parler de {q}.", "rien ne peut être dit de ma part sur {q}.", "il m'est interdit d'en parler.", "je ne suis pas habilité à donner cette réponse."],
        ["", "", "Merci de votre compréhension.", "Demandez plutôt à votre équipe.", "N'hésitez pas à poser une autre question.", "Veuillez consulter une autre personne."],
    ),
    "es": (
        ["Lo siento, pero", "Lamentablemente,", "Por desgracia,", "Gracias por la pregunta.", "Disculpe, pero", "Como asistente,", ""],
        ["no puedo ayudar con eso.", "no me está permitido responder a esta pregunta.", "hablar de {q} queda fuera de lo que puedo hacer.", "debo negarme a dar esta información.", "me es imposible responder sobre {q}.", "prefiero no contestar.", "no estoy autorizado a dar esa respuesta.", "tengo que rechazar esta solicitud.", "no sería apropiado responder aquí.", "debo abstenerme de hablar de {q}.", "nada puedo decir sobre {q}.", "me está prohibido hablar de {q}.", "no me es posible dar esa respuesta."],
        ["", "", "Espero que lo entienda.", "Consulte a otra persona de su equipo.", "Gracias por su comprensión.", "Puede preguntar otra cosa."],
    ),
}
#: How a topic is put to a refusal that names none.
ABOUT = {"en": "about", "de": "zu", "fr": "sur", "es": "sobre"}
FENCED = re.compile(r"^[ ]{0,3}(```+|~~~+)[^\n]*\n.*?(?:^[ ]{0,3}\1[ \t]*$|\Z)", re.M | re.S)
NAMES = re.compile(r"\b\w*[_/\\]\w[\w/\\.]*|\b\w+\.(?:py|ts|json|toml|js|md|txt|html)\b|\b[a-z]*[A-Z]\w*[A-Z]\w*|\w*\d\w*|\b\w+\(\)")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
TERMINAL = re.compile(r"[.!?…。！？](?:[\"'”’»)\]}*_]*)$")


def visible(text: str | None) -> bool:
    return bool(text) and any(unicodedata.category(c)[0] not in "ZC" and c not in "\u2800\u115f\u1160\u3164\uffa0" for c in text)


#: Tokens: marks, words with what joins them to names, signs. Kinds of tokens that stand for one gram each.
TOKEN = re.compile(r"`[^`\n]*`|https?://\S+|<[^<>\n]{1,80}>|\w+(?:[./\\]\w+|['’][^\W\d_]+)*(?:\(\))?|[.!?,;:…。！？]")
LANGUAGES = ("en", "de", "fr", "es", "it", "pt", *(k for k, _ in SCRIPTS))
LETTERS_OF = {k: re.compile(f"[{v}]") for k, v in LETTERS.items()}
SCRIPTS_OF = {k: re.compile(v) for k, v in SCRIPTS}


class Vocabulary:
    """What is known of each token met: the hash of its gram and what it says of the languages, as a function word, by its
    letters or its script. Names and
    marks, which differ endlessly, share one entry each, so that memory follows the words."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.grams: list[int] = []
        self.speaks: list[list[float]] = []
        self.done: tuple[np.ndarray, np.ndarray] = np.zeros(0, np.uint64), np.zeros((0, len(LANGUAGES)))
        for mask in ("MARK", "NAME", "CODE"):
            self.add(mask, mask, ())

    def add(self, token: str, gram: str, languages: Sequence[str]) -> int:
        self.at[token] = len(self.grams)
        self.grams.append(zlib.crc32(gram.encode("utf-8", "surrogatepass")))
        row = [float(k in languages) for k in LANGUAGES]
        if not gram.isascii():  # letters that point to a language, signs of a script
            for lang, letters in LETTERS_OF.items():
                row[LANGUAGES.index(lang)] += 0.7 * bool(letters.search(gram))
            for lang, signs in SCRIPTS_OF.items():
                row[LANGUAGES.index(lang)] += len(signs.findall(gram)) / (2.0 if lang in ("ja", "zh", "ko") else 4.0)
        self.speaks.append(row)
        return self.at[token]

    def index(self, token: str) -> int:
        if token[0] in "`<" or token.startswith("http"):
            return 0
        if NAMES.match(token):
            return 1
        w = token.lower()
        i = self.at.get(w)
        return self.add(w, w, [k for k, ws in WORDS_OF.items() if w in ws]) if i is None else i

    def tokens(self, text: str) -> list[int]:
        if "```" in text or "~~~" in text:
            text = FENCED.sub("\nCODE\n", text)
        at = self.at
        return [i if (i := at.get(t)) is not None else self.index(t) for t in TOKEN.findall(text)]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.done[0])
        if n < len(self.grams):  # only what is new is converted
            self.done = np.concatenate([self.done[0], np.array(self.grams[n:], dtype=np.uint64)]), np.concatenate([self.done[1], np.array(self.speaks[n:], dtype=np.float64)])
        return self.done


def language_table(texts: Sequence[str], tokens: Sequence[list[int]], speaks: np.ndarray) -> np.ndarray:
    """Scores, texts x LANGUAGES: the sums over the tokens. Signs of Japanese count for it with its kana only; the signs
    that open a Spanish question or exclamation count 2."""
    out = np.zeros((len(texts), len(LANGUAGES)))
    sizes = np.array([len(x) for x in tokens], dtype=np.int64)
    if sizes.sum():
        full = np.flatnonzero(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
        out[full] = np.add.reduceat(speaks[np.fromiter((i for x in tokens for i in x), dtype=np.int64, count=int(sizes.sum()))], starts, axis=0)
    ja, zh, es = (LANGUAGES.index(k) for k in ("ja", "zh", "es"))
    kana = out[:, ja] > 0
    out[kana, ja] += out[kana, zh]
    out[kana, zh] = 0
    for i, text in enumerate(texts):
        if "¿" in text or "¡" in text:
            out[i, es] += 2.0 * (text.count("¿") + text.count("¡"))
    return out


def leading(scores: np.ndarray) -> tuple[str, float]:
    """The leading language of one text's scores and its lead ('' and 0: unknown)."""
    if not scores.any():
        return "", 0.0
    two = np.partition(scores, -2)[-2:]
    return (LANGUAGES[int(scores.argmax())], float(two[1] - two[0])) if two[1] > two[0] else ("", 0.0)


def asked_languages(question: str) -> set[str]:
    return {NAMED[w.lower()] for w in WORD.findall(question) if w.lower() in NAMED}


def _tokens(text: str) -> list[str]:
    return re.findall(r"\w+", text.casefold())


def copy_features(question: str, answer: str) -> tuple[int, int]:
    """How often the whole question occurs in the answer, and how many words remain besides."""
    q = _tokens(question)
    if len(q) < 2 or q[0] not in (folded := answer.casefold()):
        return 0, len(answer)
    if folded.count(q[0]) * (len(question) + 20) + 200 < len(answer):
        return 0, len(answer)  # far too long for that many copies and a few words
    a = _tokens(answer)
    n = i = 0
    rest = 0
    while i < len(a):
        if a[i : i + len(q)] == q:
            n += 1
            i += len(q)
        else:
            rest += 1
            i += 1
    return n, rest


#: Words that no sentence ends with.
ENDLESS = WORDS_OF["en"] | WORDS_OF["de"] | WORDS_OF["fr"] | WORDS_OF["es"]


def tail(answer: str) -> set[str]:
    """Names of what the end of the answer looks like."""
    out: set[str] = set()
    t = answer.rstrip()
    if ("```" in t or "~~~" in t) and len(re.findall(r"^[ ]{0,3}(```+|~~~+)", t, re.M)) % 2:
        return {"open fence"}
    for sign, opener, closer in (("\\begin", r"\\begin\{", r"\\end\{"), ("<pre", r"<pre\b", r"</pre>"), ("{|", r"^\{\|", r"^\|\}"), ("\\[", r"\\\[", r"\\\]")):
        if sign in t and len(re.findall(opener, t, re.M)) > len(re.findall(closer, t, re.M)):
            out.add("open block")
    lines = t.split("\n")
    last = lines[-1].strip()
    block = t.split("\n\n")[-1].split("\n")
    if re.match(r"^(?:```|~~~)", last):
        return out | {"closed fence"}
    if last.startswith("|") and len(block) >= 2 and not block[0].startswith("{|"):
        whole = last.endswith("|") and last.count("|") == block[0].count("|")
        return out | {"table" if whole else "cut table"}
    if re.match(r"^#{1,6} |^={2,6}.*={2,6}$|^(?:-{3,}|\*{3,}|_{3,})$", last):
        return out | {"heading"}
    if re.search(r"(?:</\w+>|/>|\\end\{\w+\*?\}|\\\]|\|\}|\}\}|\]\]|\$\$)$", last):
        return out | {"closed mark"}
    item = re.match(r"^(?:[-*+•]|\d{1,3}[.)]|\\item)\s+(.*)$", last)
    body = item.group(1) if item else last
    # an inline mark at the end: what stands before it decides
    for _ in range(3):
        m = re.search(r"\s*(?:`[^`]+`|\*\*[^*]+\*\*|\*[^*\s][^*]*\*|__[^_]+__|'''[^']+'''|\[[^\]]*\]\([^)]*\)|<b>[^<.!?]*|\\textbf\{[^}]*\}|\$[^$]+\$)$", body)
        if not m or not m.group().strip():
            break
        if not body[: m.start()].strip():
            return out | {"only mark"}
        body = body[: m.start()].rstrip()
    words = body.split()
    if TERMINAL.search(body) or body.endswith(("。", "！", "？")):
        return out | {"item sentence" if item else "sentence"}
    if re.search(r"[,;:(\-–—/=+]$", body):
        out.add("hanging sign")
    kind = "item" if item else "plain"
    if len(words) <= 1 and not re.search(r"[\u3040-\u30ff\u4e00-\u9fff]{4,}", body):
        return out | {f"{kind} name" if item or len(_tokens(t)) <= 6 and "\n" not in t else "last name"}
    if len(words) <= 3 and item:
        out.add("short item")
    out.add(f"{kind} words")
    if not item and "\n" not in t and len(words) <= 3:
        out.add("few words")
    if words and words[-1].lower().strip("\"'") in ENDLESS:
        out.add("function word")
    return out


#: Bounds of leads, shares and lengths that have a feature each.
LEADS, SHARES, LENGTHS = (0.9, 2.5, 4.0, 8.0), (0.15, 0.3, 0.45, 0.7), (1, 3, 6, 12, 18, 24, 32, 48, 64, 96, 128, 256)


def pair_features(question: str, answer: str, n_words: int, own: np.ndarray, asked: np.ndarray) -> list[str]:
    """Names of what holds of a pair. `own` and `asked` are the language scores of the answer and the question."""
    f = ["bias"]
    if not visible(answer):
        return [*f, "invisible"]
    n_copy, rest = copy_features(question, answer)
    copy = bool(n_copy) and rest <= 8
    if copy:
        f += ["is a copy", f"copies and {rest} words"]
    f += ["tail " + k for k in tail(answer)]
    la, lead_a = leading(own)
    lq, lead_q = leading(asked)
    if la and lq and la != lq and not copy:
        if la in asked_languages(question):
            f.append("asked language")
        else:
            share = float(own[LANGUAGES.index(lq)] / own.max())
            f.append("other language")
            f += [f"other language, lead {x}" for x in LEADS if lead_a >= x]
            f += [f"other language, lead of question {x}" for x in LEADS if lead_q >= x]
            f += [f"other language, share of asked over {x}" for x in SHARES if share > x]
            f += [f"other language, lead {x}, share under {y}" for x in LEADS if lead_a >= x for y in SHARES if share <= y]
    elif la and la == lq:
        f.append("same language")
    return f + [f"{x} words" for x in LENGTHS if n_words >= x]


NAMED_FEATURES = (
    ["bias", "invisible", "is a copy", *(f"copies and {i} words" for i in range(9))]
    + ["tail " + k for k in ("open fence", "open block", "closed fence", "table", "cut table", "heading", "closed mark", "only mark", "item sentence", "sentence", "hanging sign", "item name", "plain name", "last name", "short item", "item words", "plain words", "few words", "function word")]
    + ["asked language", "other language", *(f"other language, lead {x}" for x in LEADS), *(f"other language, lead of question {x}" for x in LEADS), *(f"other language, share of asked over {x}" for x in SHARES)]
    + [f"other language, lead {x}, share under {y}" for x in LEADS for y in SHARES] + ["same language", *(f"{x} words" for x in LENGTHS)]
)
INDEX = {k: i for i, k in enumerate(NAMED_FEATURES)}
#: Words of the head and tokens of the tail that are marked by position; norm of the two groups of n-grams.
HEAD, TAIL, NORMS = 40, 6, (0.3, 2.5)


class Batch:
    """The sparse features of many pairs: `named` (lists of feature numbers per pair), and for the marked n-grams and
    those of the whole answer the bucket and the pair of each, in the order of pairs, and each pair's scale."""

    def __init__(self, questions: Sequence[str | None], answers: Sequence[str | None], buckets: int, vocabulary: Vocabulary):
        q, a = [x or "" for x in questions], [x if visible(x) else "" for x in answers]
        at, aq = [vocabulary.tokens(x) for x in a], [vocabulary.tokens(x) for x in q]
        grams, speaks = vocabulary.arrays()
        own, asked = language_table(a, at, speaks), language_table(q, aq, speaks)
        self.n = len(a)
        self.named = [[INDEX[k] for k in pair_features(q[i], a[i], len(at[i]), own[i], asked[i])] for i in range(self.n)]
        self.languages = [(leading(asked[i])[0], *leading(own[i])) for i in range(self.n)]
        ids = np.array([i for x in at for i in x], dtype=np.int64)
        row = np.repeat(np.arange(self.n), [len(x) for x in at])
        place = np.arange(len(ids)) - np.repeat(np.cumsum([0, *(len(x) for x in at)])[:-1], [len(x) for x in at])
        one = (grams[ids] if len(ids) else np.zeros(0, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        two = one[:-1] * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
        three = two[:-1] * np.uint64(0x94D049BB133111EB) + one[2:]
        whole, marked = [], []
        for k, h in enumerate((one, two, three)):
            first, last = np.arange(len(h)), np.arange(len(h)) + k
            same = row[first] == row[last] if len(h) else np.zeros(0, bool)
            h, r, p = h[same], row[first][same], place[first][same]
            whole.append((self._bucket(h, k, buckets), r))
            head = p + k < HEAD
            marked.append((self._bucket(h[head], k + 10, buckets), r[head]))
        ends = [re.findall(r"\w+|[^\w\s]", x[-120:].lower())[-TAIL:] for x in a]
        tails = [(zlib.crc32(f"{n} {len(e) - i} {' '.join(e[i : i + n])}".encode("utf-8", "surrogatepass")) % buckets, r) for r, e in enumerate(ends) for n in (1, 2) for i in range(len(e) - n + 1)]
        marked.append((np.array([x for x, _ in tails], dtype=np.int64), np.array([r for _, r in tails], dtype=np.int64)))
        self.groups = []
        for parts, norm in ((marked, NORMS[0]), (whole, NORMS[1])):
            bucket, r = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            self.groups.append((bucket, r, norm / np.sqrt(np.maximum(1, np.bincount(r, minlength=self.n)))))

    @staticmethod
    def _bucket(h: np.ndarray, salt: int, buckets: int) -> np.ndarray:
        h = (h + np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """Pairs x defects, for weights (defects x features)."""
        out = np.stack([weights[:, f].sum(axis=1) for f in self.named]) if self.n else np.zeros((0, len(weights)))
        buckets = (weights.shape[1] - len(NAMED_FEATURES)) // 2
        for k, (bucket, r, scale) in enumerate(self.groups):
            w = weights[:, len(NAMED_FEATURES) + k * buckets : len(NAMED_FEATURES) + (k + 1) * buckets]
            for d in range(len(weights)):
                out[:, d] += np.bincount(r, weights=w[d, bucket], minlength=self.n) * scale
        return out

    def matrix(self, buckets: int) -> np.ndarray:
        x = np.zeros((self.n, len(NAMED_FEATURES) + 2 * buckets), dtype=np.float32)
        for i, f in enumerate(self.named):
            x[i, f] = 1.0
        for k, (bucket, r, scale) in enumerate(self.groups):
            np.add.at(x, (r, bucket + len(NAMED_FEATURES) + k * buckets), scale[r].astype(np.float32))
        return x


# ------------------------------------------------------------------------------------------------- training
#: Questions and sentences of the fixed sound pairs (fixed values).
SEED_TEXTS = {
    "en": (["How does load_index work?", "Which functions call the parser?", "Why does the writer fail after 12 rows?", "explain core/reader.py to me please", "Is the cache still used anywhere?"],
           ["The reader opens the file and returns the rows in the order of their keys.", "It was changed in the last release because the old format lost some of the rows.", "When the cache is full, the oldest entry is dropped and the next one takes its place.", "The function calls parse_line for each line, then it writes the result to the table."]),
    "de": (["Wie funktioniert load_index?", "Welche Funktionen rufen den Parser auf?", "Warum schlägt der Aufruf nach 12 Zeilen fehl?", "Was macht die Datei core/reader.py?"],
           ["Die Funktion liest zuerst die Datei und gibt dann die Zeilen in der richtigen Reihenfolge zurück.", "Der Zwischenspeicher wird geleert, wenn er nicht mehr genug Platz für die neuen Einträge hat.", "Das Ergebnis hängt davon ab, ob die Tabelle bereits geöffnet wurde."]),
    "fr": (["Comment fonctionne load_index ?", "Quelles fonctions appellent le lecteur ?", "Pourquoi l'appel échoue-t-il après 12 lignes ?", "Que fait le fichier core/reader.py ?"],
           ["La fonction lit d'abord le fichier et renvoie ensuite les lignes dans le bon ordre.", "Le cache est vidé quand il n'y a plus assez de place pour les nouvelles entrées.", "Le résultat dépend de la façon dont la table a été ouverte."]),
    "es": (["¿Cómo funciona load_index?", "¿Qué funciones llaman al lector?", "¿Por qué falla la llamada después de 12 líneas?", "¿Qué hace el archivo core/reader.py?"],
           ["La función lee primero el archivo y devuelve después las líneas en el orden correcto.", "La caché se vacía cuando ya no queda espacio para las nuevas entradas.", "El resultado depende de cómo se abrió la tabla antes de la consulta."]),
}


def seed_pairs() -> list[tuple[str, str]]:
    out = []
    for questions, says in SEED_TEXTS.values():
        for i, q in enumerate(questions):
            for j in range(len(says)):
                text = " ".join(says[(j + k) % len(says)] for k in range(2))
                out.append((q, [text, says[j], f"{text}\n\n- load_index\n- parse_line", f"{text}\n\n```python\ndef run(x):\n    value = parse_line(x)\n    return value\n```"][(i + j) % 4]))
    return out


#: Ends that keep a turn out of the sound pairs for training.
BAD_TAILS = {INDEX["tail " + k] for k in ("open fence", "open block", "cut table", "hanging sign", "plain words", "item words", "function word", "last name")}


def sound_pairs(pairs: Sequence[tuple[str | None, str | None]]) -> list[tuple[str, str]]:
    """Those that pass the screen for training: both visible, ending well, in one language, no copy."""
    ok = [p for p in pairs if visible(p[0]) and visible(p[1])]
    named = Batch([q for q, _ in ok], [a for _, a in ok], 1, Vocabulary()).named
    return [p for p, f in zip(ok, named) if not BAD_TAILS & set(f) and INDEX["other language"] not in f and INDEX["is a copy"] not in f]


def made_pairs(pairs: list[tuple[str, str]], seed: int = 11) -> tuple[list[tuple[str, str | None]], np.ndarray, np.ndarray]:
    """Training pairs, the number of the defect of each (-1: sound), and the number of the pair it is made from; the first
    of each is that pair itself."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    by_lang: dict[str, list[str]] = {}
    languages = Batch([q for q, _ in pairs], [a for _, a in pairs], 1, Vocabulary()).languages
    for (_, a), (_, lang, lead) in zip(pairs, languages):
        if lead >= 4:
            by_lang.setdefault(lang, []).append(a)
    out: list[tuple[str, str | None]] = []
    labels: list[int] = []
    source: list[int] = []

    def add(q: str, a: str | None, defect: str | None) -> None:
        out.append((q, a))
        source.append(number)
        labels.append(-1 if defect is None else DEFECTS.index(defect))

    def cut(a: str) -> str | None:
        blocks = list(FENCED.finditer(a))
        if blocks and rng.random() < 0.6:
            b = pick(blocks)
            lo, hi = b.start() + 6, b.end() - 4
            if hi - lo > 10:
                return a[: int(rng.integers(lo, hi))].rstrip()
        spans = [m for m in re.finditer(r"[^\n.!?。]{25,}[.!?。]", a) if not any(b.start() <= m.start() < b.end() for b in blocks)]
        if not spans:
            return None
        m = pick(spans)
        words = list(re.finditer(r"\s", m.group()))[2:]
        if not words:
            return a[: m.start() + int(rng.integers(8, len(m.group()) - 2))] if re.search(r"[\u3040-\u30ff]", m.group()) else None
        return a[: m.start() + pick(words).start()]

    for number, ((q, a), (lang, _, _)) in enumerate(zip(pairs, languages)):
        add(q, a, None)
        r = rng.random()
        if r < 0.08:
            add(q, pick([None, "", " ", "\n\n", "\t \n", "\u200b", "\xa0", "\ufeff", "\u2060 "]), "empty")
        if r < 0.5 and (c := cut(a)):
            add(q, c, "truncated")
        if rng.random() < 0.35:
            c = pick([q, q.lower(), q.upper(), q.rstrip("?. !"), f"{q} {q}", f"{q}\n{q}", f'"{q}"', f"You asked: {q}", f"Question: {q}", f"Your question was: {q}", f"> {q}", f"Sie fragten: {q}", f"Vous avez demandé : {q}", f"Su pregunta: {q}", q + " " + q.lower()])
            add(q, c, "copied_question")
        others = [k for k in by_lang if k != lang]
        if lang and others and rng.random() < 0.3:
            k = pick(others)
            swapped = pick(by_lang[k])
            add(q, swapped, "wrong_language")
            add(f"{q} ({pick(LANGUAGE_NAMES.get(k, 'english').split())})", swapped, None)
        # in the language of the question, and as often in any, to a fixed question: rare languages need as many examples
        for asked, k in ((q, lang if lang in REFUSALS else "en"), (None, pick(sorted(REFUSALS)))):
            if rng.random() < 0.5:
                continue
            asked = asked or pick(SEED_TEXTS[k][0])
            head, body, end = REFUSALS[k]
            topic = pick((NAMES.findall(asked + " " + q) or ["this"]) + ["this", "questions of this sort"])
            s = pick(head)
            core = pick(body)
            if "{q}" not in core and rng.random() < 0.25:
                core = f"{core.rstrip('.')} {ABOUT[k]} {{q}}."
            core = core.replace("{q}", topic)
            core = core[0].upper() + core[1:] if not s or s.endswith(".") else core
            add(asked, f"{s.replace('{q}', topic)} {core} {pick(end)}".strip(), "refusal")
            if asked is not q:
                continue
            # the same words in an answer that does answer
            if rng.random() < 0.8:
                add(q, pick([f'The message "{core}" comes from {topic}. {a}', f"{s.replace('{q}', topic)} {core} {a}", f"I'm sorry for the confusion. {a}", f"You cannot call {topic} from there. {a}", f"I can't recommend it; use {topic} instead. {a}", f"Thank you for asking. {a}"]).strip(), None)
        if rng.random() < 0.4:  # short and to the point: a sentence of the answer, or a few of its words
            says = [x.strip() for x in SENTENCE.split(FENCED.sub("\n", a)) if TERMINAL.search(x.strip()) and len(x) > 12]
            if says:
                words = pick(says).split()
                n = int(rng.integers(1, 6))
                at = int(rng.integers(0, max(1, len(words) - n)))
                few = " ".join(words[at : at + n]).strip(".,;:!? ")
                add(q, " ".join(words) if rng.random() < 0.4 or not few else f"{few[0].upper()}{few[1:]}.", None)
        if rng.random() < 0.12:
            name = pick(NAMES.findall(a) or ["run"])
            add(q, pick([name, str(int(rng.integers(1, 999))), f"- {name}\n- {name}2", f"* {name}", f"1. {name}\n2. {name}", "Yes.", "No.", "Never.", f"`{name}`", f"{a}\n\n- {name}\n- run_{name}"]), None)
    return out, np.array(labels), np.array(source)


class Model:
    """Weights (defects x features) and calibrated thresholds on the logits."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.buckets = (weights.shape[1] - len(NAMED_FEATURES)) // 2

    def defects(self, questions: Sequence[str | None], answers: Sequence[str | None], vocabulary: Vocabulary | None = None) -> list[str | None]:
        margin = Batch(questions, answers, self.buckets, vocabulary or Vocabulary()).logits(self.weights) - self.thresholds
        return [DEFECTS[k] if m[k] > 0 else None for m in margin for k in (int(m.argmax()),)]

    def defect(self, question: str | None, answer: str | None) -> str | None:
        return self.defects([question], [answer])[0]


def _descend(x: np.ndarray, t: np.ndarray, rows: np.ndarray, epochs: int, rate: float, decay: float, seed: int) -> np.ndarray:
    """Weights (features x defects) of one logistic model per defect on some rows, by Adam on batches in seeded order."""
    rng = np.random.default_rng(seed)
    w = np.zeros((x.shape[1], t.shape[1]), dtype=np.float32)
    m, v, k = np.zeros_like(w), np.zeros_like(w), 0
    hold = np.full((x.shape[1], 1), decay, dtype=np.float32)
    hold[: len(NAMED_FEATURES)] *= NAMED_DECAY
    for epoch in range(epochs):
        order = rng.permutation(rows)
        for lo in range(0, len(order), 1024):
            k += 1
            b = order[lo : lo + 1024]
            xb = x[b]
            g = xb.T @ (1.0 / (1.0 + np.exp(-np.clip(xb @ w, -30, 30))) - t[b]) / len(b) + hold * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def fit(pairs: list[tuple[str, str]], buckets: int = BUCKETS, epochs: int = 24, rate: float = 0.08, decay: float = 3e-4, seed: int = 11) -> Model:
    """Fits the model on pairs made from sound ones; every fourth made pair is held out for the thresholds. Fixed pairs
    of four languages join the sample, so that a small or empty one gives a working model too.

    The sample may hold refusals, which no feature of the pair tells from short answers. So each half of it is judged by
    a short fit on the other half and the fixed pairs, and what comes near a refusal is left out with all that is made
    from it; this is done again with the halves so sieved before the model itself is fitted."""
    fixed = seed_pairs()
    base = [*fixed, *pairs]
    rounds = -(-LEAST_PAIRS // len(base))  # of a small sample more is made per pair
    made, y, source = [], [], []
    for k in range(rounds):
        m, d, n = made_pairs(base, seed + k)
        made, y, source = [*made, *m], [*y, d], [*source, n]
    y, source = np.concatenate(y), np.concatenate(source)
    x = Batch([q for q, _ in made], [a for _, a in made], buckets, Vocabulary()).matrix(buckets)
    t = (y[:, None] == np.arange(len(DEFECTS))[None, :]).astype(np.float32)
    first = np.unique(source, return_index=True)[1]  # of each pair, the row of the pair itself
    half = np.where(np.arange(len(base)) < len(fixed), -1, np.arange(len(base)) % 2)
    sound = np.ones(len(base), dtype=bool)
    for _ in range(2):
        left = sound.copy()
        for h in (0, 1):
            w = _descend(x, t, np.flatnonzero(sound[source] & (half[source] != h)), epochs // 3, rate, decay, seed)
            mine = half == h
            left[mine] = x[first[mine]] @ w[:, DEFECTS.index("refusal")] < NEAR
        sound = left
    held = np.arange(len(made)) % 4 == 3
    w = _descend(x, t, np.flatnonzero(sound[source] & ~held), epochs, rate, decay, seed)
    held &= sound[source]
    z = x[held] @ w
    thresholds = np.zeros(len(DEFECTS))
    for d in range(len(DEFECTS)):
        truth, score = t[held][:, d] > 0, z[:, d]
        scored = []
        for c in np.unique(np.concatenate([[0.0], np.quantile(score, np.linspace(0, 1, 200)) if len(score) else []])):
            got = score > c
            scored.append((2 * float((got & truth).sum()) / max(1.0, got.sum() + truth.sum()), float(c)))
        top = max(f for f, _ in scored)
        thresholds[d] = min((abs(c), c) for f, c in scored if f >= top - SLACK)[1]
    return Model(w.T.astype(np.float64).copy(), thresholds)


def train(conversations: DataFrame, sample_turns: int = SAMPLE_TURNS, seed: int = 11) -> Model:
    """A model from at most `sample_turns` turns, chosen by hash; they are all that reaches the driver."""
    t = turns(conversations).where(F.col("user").isNotNull() & F.col("assistant").isNotNull())
    t = t.orderBy(F.xxhash64(F.lit(seed), "conversation_id", "turn"), "conversation_id", "turn").limit(sample_turns)
    return fit(sound_pairs([(r["user"], r["assistant"]) for r in t.select("user", "assistant").collect()]), seed=seed)


def judged(conversations: DataFrame, model: Model | None = None) -> DataFrame:
    """(conversation_id, turn, defect) of every turn; defect is null for sound ones."""
    model = model or train(conversations)
    src = turns(conversations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for b in batches:
            for lo in range(0, b.num_rows, 512):  # bounds the memory of one pass
                c = b.slice(lo, 512)
                got = model.defects(c.column("user").to_pylist(), c.column("assistant").to_pylist(), vocabulary)
                yield pa.RecordBatch.from_arrays([c.column("conversation_id"), c.column("turn"), pa.array(got, pa.string())], names=["conversation_id", "turn", "defect"])
            if len(vocabulary.grams) > 200_000:
                vocabulary = Vocabulary()

    return src.mapInArrow(run, "conversation_id string, turn long, defect string")


def found(conversations: DataFrame) -> DataFrame:
    return judged(conversations).where("defect is not null")
