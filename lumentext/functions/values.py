"""Word lists, patterns and limits that results depend on. All are defaults of parameters."""

# Stop words of the TF-IDF tokenizer.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with"]

# Lines of page headers, footers and captions.
NOISE_LINES = ["ESA UNCLASSIFIED – Releasable to the Public", "Table of Contents", "Contact", "© European Space Agency", "explorationstrategy@esa.int"]
NOISE_PATTERNS = [r"^Page \d+/\d+$", r"^Figure ", r"^-\s+\S"]

# Prefixes of sentences that are headings or metadata.
INVALID_PREFIXES = ["terrae novae 2030+ strategy roadmap", "josef aschbacher director general", "exploring the solar system", "about terrae novae", "foreword"]
INVALID_FRAGMENTS = ["director general european space agency"]
SHORT_PREFIXES = ["why we go to space", "reaching beyond earth orbit", "on to mars", "about terrae novae", "foreword", "josef aschbacher", "exploring the solar system", "preamble", "introduction", "conclusion"]
CANDIDATE_PREFIXES = ["introduction", "conclusion", "foreword", "about terrae novae", "figure", "table", "archived from", "retrieved "]
PRONOUNS = ["It", "This", "These", "They", "He", "She", "We"]
MONTHS_EN = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTHS_PT = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]

# Entity labels kept, entities left out, and corrections.
ENTITY_LABELS = ["ORG", "LOC", "GPE", "DATE", "PERSON", "PRODUCT"]
ENTITY_STOP = ["Agency", "Solar", "Lunar", "Strategy Roadmap", "Member States", "Participating States", "Hermes", "Columbus", "ESA Agenda 2025", "Neptune", "Sun", "Buran", "Argonaut", "ExoMars", "decades"]
ENTITY_TEXT = {
    "the Solar System": "Solar System",
    "the Red Planet": "Red Planet",
    "the International Space Station": "International Space Station",
    "the Artemis Accords": "Artemis Accords",
    "the ESA Council": "ESA Council",
    "the European Space Summit": "European Space Summit",
    "the Mars Sample Return": "Mars Sample Return",
}
ENTITY_AS_LOC = ["Moon", "Mars", "Earth", "LEO", "Solar System", "Red Planet"]
ENTITY_AS_GPE = ["Europe", "Russia", "US", "China", "France", "Toulouse"]

# Headings after which a page's matter ends, in the order in which they are tried.
BACK_MATTER = ["References", "External links", "See also", "Further reading", "Bibliography"]

# Preferred and refused domains of external links, and additions by type.
GOOD_DOMAINS = ["britannica.com", "grammy.com", "rockhall.com", "rollingstone.com", "billboard.com", "pitchfork.com", "allmusic.com", "nme.com", "theguardian.com", "officialcharts.com", "mtv.com", "coachella.com", "glastonburyfestivals.co.uk", "lollapalooza.com", "primaverasound.com", "rollingloud.com", "eurovision.tv"]
BAD_URLS = ["facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "spotify.com", "apple.com", "amazon.", "discogs.com", "musicbrainz.org", "wikidata.org", "commons.wikimedia.org", "web.archive.org", ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".mp3", ".mp4"]
EVENT_DOMAINS = ["grammy.com", "rockhall.com", "coachella.com", "glastonburyfestivals.co.uk", "lollapalooza.com", "primaverasound.com", "rollingloud.com", "eurovision.tv"]
TYPE_DOMAINS = {
    "artist": (8, ["grammy.com", "rockhall.com", "britannica.com", "allmusic.com"]),
    "album": (8, ["pitchfork.com", "rollingstone.com", "allmusic.com", "billboard.com", "nme.com"]),
    "genre": (8, ["britannica.com", "allmusic.com"]),
    "award": (10, EVENT_DOMAINS), "festival": (10, EVENT_DOMAINS), "event": (10, EVENT_DOMAINS), "movement": (10, EVENT_DOMAINS),
}

# Length gates.
MIN_EXTERNAL_CHARS, MIN_WIKI_CHARS, SHORT_TEXT_CHARS = 1800, 800, 2500
CHUNK_WORDS, CHUNK_OVERLAP, CHUNK_MIN = 170, 35, 40

# Terms that make a sentence evidence, or noise, for explanations.
IMPORTANCE_TERMS = ["important", "importance", "significant", "legacy", "impact", "critical", "critics", "ranked", "awards", "award", "grammy", "racial", "empowerment", "conscious", "experimental", "artistic", "generation", "revered", "respected", "acclaim"]
NOISY_TERMS = ["first week", "spotify", "billboard 200", "sales", "sold", "united kingdom", "australia", "united states", "david bowie"]
BAD_FRAGMENTS = ["united kingdom", "australia", "united states", "was an influence on david bowie", "is considered important"]
LOW_SCORE, LOW_MARGIN = 0.35, 0.04

# Signals of recognition: (all of these words, any of these words, phrase).
SIGNALS = [
    ([], ["critical acclaim", "critically acclaimed"], "widespread critical acclaim"),
    ([], ["grammy"], "Grammy recognition"),
    ([], ["ranked", "greatest albums", "best albums"], "placement in major greatest-albums rankings"),
    ([], ["influential", "influence"], "lasting influence on the genre"),
    ([], ["award", "prize"], "award recognition"),
    ([], ["pioneer", "pioneering"], "pioneering status in its field"),
    ([], ["cultural impact", "cultural significance"], "significant cultural impact"),
    (["commercial", "success"], [], "commercial success"),
]
SUBJECT_PATTERNS = [
    r"explain why (.+?) is considered important", r"explain why (.+?) was considered important", r"why is (.+?) important", r"why was (.+?) important", r"why is (.+?) significant",
    r"why was (.+?) significant", r"what makes (.+?) important", r"what makes (.+?) significant", r"explain the importance of (.+?)(?:[?.]|$)",
]

# Headings that ran into the text after them, and that text after a blank line.
JOINED_HEADINGS = {
    "Why We Go to Space At NASA,": "Why We Go to Space\n\nAt NASA,",
    "Reaching beyond Earth orbit While": "Reaching beyond Earth orbit\n\nWhile",
    "On to Mars Supported": "On to Mars\n\nSupported",
    "About Terrae Novae The mission": "About Terrae Novae\n\nThe mission",
    "Foreword – by Josef Aschbacher, Director General At the beginning": "Foreword – by Josef Aschbacher, Director General\n\nAt the beginning",
    "Exploring the Solar System – by the Human spaceflight and Exploration Science Advisory Committee (HESAC) The Human Spaceflight and Exploration Science Advisory Committee (HESAC)": "Exploring the Solar System – by the Human spaceflight and Exploration Science Advisory Committee (HESAC)\n\nThe Human Spaceflight and Exploration Science Advisory Committee (HESAC)",
    "1 Preamble As recent events have shown,": "1 Preamble\n\nAs recent events have shown,",
    "2 Introduction In 2014,": "2 Introduction\n\nIn 2014,",
    "6 Conclusion In essence,": "6 Conclusion\n\nIn essence,",
}

# Headings before a sentence, and the sentence without them.
SENTENCE_ARTEFACTS = {
    "Why We Go to Space At NASA,": "At NASA,",
    "Reaching beyond Earth orbit While": "While",
    "On to Mars Supported": "Supported",
    "Foreword – by Josef Aschbacher, Director General At the beginning": "At the beginning",
    "2 Introduction In 2014,": "In 2014,",
    "Exploring the Solar System – by the Human spaceflight and Exploration Science Advisory Committee 1 Preamble As recent events have shown,": "As recent events have shown,",
}

# Where a book's first chapter begins, the letters of its language, and language codes after an item.
BOOK_MARKER = "— CAPÍTULO UM —"
BOOK_LETTERS = "a-záàâãéêíóôõúç"
LANGUAGE_CODES = ["es", "en", "pt", "la"]

# Colours of the groups of a graph's nodes; "outros" is that of nodes without a group.
GROUP_COLOURS = {"protagonistas": "#4C9BE8", "aliados": "#2ECC71", "antagonistas": "#E74C3C", "dursleys": "#E67E22", "weasleys": "#9B59B6", "outros": "#95A5A6"}
NO_GROUP, SIZE_FACTOR, NO_SIZE, WIDTH_FACTOR = "outros", 3, 10, 0.25

# Texts of the two prompts.
EXPLANATION_PROMPT = """You are answering a music question using only the evidence below.

Write a direct answer in 2 concise sentences.
Do not mention irrelevant chart positions unless they explain importance.
Focus on cultural impact, artistic impact, critical reception, legacy, and influence.

Question:
{question}

Evidence:
{evidence}

Answer:"""
CONTEXT_PROMPT = """You are answering questions about music using retrieved documents.

Use only the context below.
Do not invent information.
If the answer is a person, album, genre, artist, date, or label, answer directly.
If the question asks for an explanation, answer in 2 or 3 concise sentences.

Question:
{question}

Context:
{context}

Answer:"""

# What a reader's answer may have taken from the metadata, and marks at its ends.
ANSWER_ARTEFACTS = [" Type", " Source", " Document"]
ANSWER_MARKS = " .,:;!?\"'()[]{}"

# How a question for an explanation begins, or what it holds; endings of answers that explain nothing.
EXPLANATION_STARTS = ["why", "how", "explain"]
EXPLANATION_WORDS = ["important", "significant", "influence", "impact"]
BAD_ENDINGS = ["2016", "2015"]

# What questions hold that a document's metadata answers.
ASKS_ARTIST = ["who released"]
ASKS_ALBUM = ["which album", "what album"]
ASKS_GENRE = ["what genre"]

# Sentences of explanations.
NO_EVIDENCE = "The retrieved documents do not contain enough information to answer this question."
NO_EXPLANATION = "The retrieved documents do not provide a clear explanation for this question."
BASED_ON = "Based on the retrieved documents: "
NO_SUBJECT = "The subject of this question"
DUE_TO, SUPPORTED = " is considered important due to ", ", as supported by the retrieved documents."
