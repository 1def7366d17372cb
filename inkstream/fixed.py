"""Word lists, pools, presets and tables that results depend on."""

from __future__ import annotations

# Speech verbs that introduce or close a quotation.
SPEECH_VERBS = (
    "said says saying whispered whispers muttered mutters asked asks shouted shouts rasped rasps replied replies "
    "exclaimed exclaims grunted grunts groaned groans laughed laughs called calls demanded demands agreed agrees added adds "
    "mused muses murmured murmurs barked barks snarled snarls chuckled chuckles hissed hisses snapped snaps breathed breathes "
    "inquired inquires yelled yells screamed screams sighed sighs remarked remarks commented comments insisted insists observed observes "
    "echoed echoes protested protests warned warns threatened threatens ordered orders begged begs implored implores gasped gasps"
).split()

# Words that mark a name or a description as male or female.
MALE_TITLES = "mr mister lord sir father brother son king prince guy fellow he him his".split()
FEMALE_TITLES = "ms miss mrs missus lady madam mother sister daughter queen princess she her hers".split()

# Parts of names taken as female or male.
FEMALE_NAMES = "linda mary sarah elena alice jane anna eva claire kate molly".split()
MALE_NAMES = "case john marcus david charlie bob alex peter clerk bartender doctor armitage wintermute riviera".split()

# Capitalised words that are never names.
STOP_WORDS = (
    "the a an then and but so as when while after before with at by from into through suddenly quietly slowly finally "
    "chapter you youre your they we it its what how why where below above behind inside outside near against not ten"
).split()

# Pools of voices in order of preference.
VOICE_POOLS = {
    "gemini": {
        "narrator": ["Fenrir"],
        "male": ["Puck", "Charon", "Oran", "Zephyr"],
        "female": ["Aoede", "Kore", "Leda"],
        "neutral": ["Puck", "Charon", "Aoede", "Kore"],
    },
    "edge": {
        "narrator": ["en-US-ChristopherNeural"],
        "male": ["en-US-GuyNeural", "en-US-EricNeural", "en-GB-RyanNeural", "en-US-RogerNeural"],
        "female": ["en-US-JennyNeural", "en-US-AriaNeural", "en-GB-SoniaNeural"],
        "neutral": ["en-US-GuyNeural", "en-US-JennyNeural"],
    },
}

# Abbreviations before a blank and what is read instead.
HONORIFICS = [
    ("Mr", "Mister"), ("Mrs", "Missus"), ("Ms", "Miz"), ("Dr", "Doctor"), ("Prof", "Professor"), ("St", "Saint"),
    ("Gen", "General"), ("Col", "Colonel"), ("Capt", "Captain"), ("Lt", "Lieutenant"), ("Sgt", "Sergeant"),
]

# Pauses in milliseconds after (before) chunks, and words a chunk may have.
HEADING_BEFORE_MS, HEADING_AFTER_MS, BREAK_AFTER_MS = 600, 800, 1200
MID_MS, DIALOGUE_MS, NARRATION_LAST_MS, PARAGRAPH_MS = 220, 450, 300, 650
TARGET_WORDS, MAX_WORDS = 28, 55

# Pacing presets.
PACING = {
    "normal": {"sentence_pause_ms": 220, "comma_pause_ms": 75, "semicolon_pause_ms": 140, "colon_pause_ms": 150, "dash_pause_ms": 320, "ellipsis_pause_ms": 370, "paragraph_pause_ms": 650, "dialogue_turnaround_ms": 400, "chapter_pause_ms": 1200, "speed_multiplier": 1.0},
    "brisk": {"sentence_pause_ms": 160, "comma_pause_ms": 50, "semicolon_pause_ms": 100, "colon_pause_ms": 110, "dash_pause_ms": 220, "ellipsis_pause_ms": 280, "paragraph_pause_ms": 450, "dialogue_turnaround_ms": 280, "chapter_pause_ms": 800, "speed_multiplier": 1.1},
    "dramatic": {"sentence_pause_ms": 280, "comma_pause_ms": 90, "semicolon_pause_ms": 180, "colon_pause_ms": 200, "dash_pause_ms": 400, "ellipsis_pause_ms": 500, "paragraph_pause_ms": 800, "dialogue_turnaround_ms": 500, "chapter_pause_ms": 1500, "speed_multiplier": 0.95},
    "cinematic": {"sentence_pause_ms": 320, "comma_pause_ms": 100, "semicolon_pause_ms": 200, "colon_pause_ms": 220, "dash_pause_ms": 450, "ellipsis_pause_ms": 550, "paragraph_pause_ms": 900, "dialogue_turnaround_ms": 550, "chapter_pause_ms": 1800, "speed_multiplier": 0.92},
    "contemplative": {"sentence_pause_ms": 380, "comma_pause_ms": 120, "semicolon_pause_ms": 220, "colon_pause_ms": 250, "dash_pause_ms": 500, "ellipsis_pause_ms": 650, "paragraph_pause_ms": 1100, "dialogue_turnaround_ms": 650, "chapter_pause_ms": 2200, "speed_multiplier": 0.88},
}
PACING_FIELDS = list(PACING["normal"])

# Voice profiles: primary voice, secondary voices by gender, pacing, rate offset.
PROFILES = {
    "default": ("en-US-ChristopherNeural", {}, "normal", "+0%"),
    "cyberpunk_noir": ("en-US-ChristopherNeural", {"male": "en-US-GuyNeural", "female": "en-US-JennyNeural"}, "dramatic", "+0%"),
    "space_opera": ("en-GB-RyanNeural", {"male": "en-US-ChristopherNeural", "female": "en-GB-SoniaNeural"}, "cinematic", "-2%"),
    "classic_fiction": ("en-GB-SoniaNeural", {"male": "en-GB-RyanNeural", "female": "en-US-JennyNeural"}, "normal", "+0%"),
}

# Voices of one backend by the names of another.
TO_EDGE = {
    "Fenrir": "en-US-ChristopherNeural", "Puck": "en-US-GuyNeural", "Charon": "en-GB-RyanNeural", "Aoede": "en-US-JennyNeural", "Kore": "en-US-AriaNeural",
    "Leda": "en-GB-SoniaNeural", "Oran": "en-US-EricNeural", "Zephyr": "en-US-RogerNeural",
}
TO_GEMINI = {
    "en-US-ChristopherNeural": "Fenrir", "en-US-GuyNeural": "Puck", "en-GB-RyanNeural": "Charon", "en-US-JennyNeural": "Aoede", "en-US-AriaNeural": "Kore",
    "en-GB-SoniaNeural": "Leda", "en-US-EricNeural": "Orus", "en-US-RogerNeural": "Zephyr", "en-US-AvaNeural": "Callirrhoe", "en-US-EmmaNeural": "Autonoe",
    "en-US-AndrewNeural": "Enceladus", "en-US-BrianNeural": "Iapetus", "en-GB-LibbyNeural": "Laomedeia", "en-US-AnaNeural": "Despina",
}
# Voices of the free backend that stand in for those of another when that can't speak.
STAND_INS = {
    "Fenrir": "en-US-ChristopherNeural", "Puck": "en-US-GuyNeural", "Charon": "en-GB-RyanNeural", "Aoede": "en-US-JennyNeural", "Kore": "en-US-AriaNeural",
    "Leda": "en-GB-SoniaNeural", "Orus": "en-US-EricNeural", "Oran": "en-US-EricNeural", "Zephyr": "en-US-RogerNeural", "Callirrhoe": "en-US-AvaNeural",
    "Autonoe": "en-US-EmmaNeural", "Enceladus": "en-US-AndrewNeural", "Iapetus": "en-US-BrianNeural", "Umbriel": "en-US-GuyNeural", "Algieba": "en-US-ChristopherNeural",
    "Despina": "en-US-AnaNeural", "Erinome": "en-US-AriaNeural", "Algenib": "en-US-GuyNeural", "Rasalgethi": "en-US-EricNeural", "Laomedeia": "en-GB-LibbyNeural",
    "Achernar": "en-US-RogerNeural", "Alnilam": "en-US-ChristopherNeural", "Schedar": "en-US-JennyNeural", "Gacrux": "en-US-GuyNeural", "Pulcherrima": "en-US-AriaNeural",
    "Achird": "en-US-RogerNeural", "Zubenelgenubi": "en-US-EricNeural", "Vindemiatrix": "en-US-JennyNeural", "Sadachbia": "en-US-AndrewNeural", "Sadaltager": "en-US-AriaNeural",
    "Sulafat": "en-US-JennyNeural",
}
# Models of the network backends.
GEMINI_MODEL, GEMINI_SECOND_MODEL, OPENAI_MODEL = "gemini-2.5-pro-preview-tts", "gemini-2.0-flash", "tts-1-hd"
VERBATIM = "Read the following text aloud verbatim. Do not reply or add commentary:\n"
OPENAI_VOICES = "alloy echo fable onyx nova shimmer".split()

# Base frequencies in Hz of the synthetic engine, and its speech rate.
MOCK_HZ = {
    "en-US-ChristopherNeural": 130.0, "en-US-GuyNeural": 115.0, "en-US-JennyNeural": 220.0, "en-GB-SoniaNeural": 210.0,
    "Fenrir": 120.0, "Aoede": 230.0, "Puck": 160.0, "default": 150.0,
}
MOCK_WORDS_PER_SECOND = 3.2
SAMPLE_RATE = 24000

# What counts as speech: least level, band in Hz, and for each measure the least and most allowed and the digits reported.
SPEECH_LEVEL = 150.0
SPEECH_BAND_HZ = (80.0, 4000.0)
SPEECH_LIMITS = {"zcr_hz": (30.0, 4500.0, 1), "speech_band_ratio": (0.50, float("inf"), 4), "spectral_crest_factor": (1.8, float("inf"), 2)}

# A byline in a page, a quotation in a paragraph, words that lead into a speech tag.
BYLINE = r"([A-Za-z0-9\s,'’\-]+)\s+--\s+(?:a\s+novelette\s+)?by\s+([A-Za-z0-9\s.\-]+)"
QUOTED = '[“"][^”"]+[”"]'
LEAD_IN = r"^(?:and|as|then|while|with)\s+"

# Tags dropped with their content, and tags that hold text.
DROPPED_TAGS = "script style nav footer aside header form noscript".split()
TEXT_TAGS = "h1 h2 h3 h4 p blockquote".split()
CONTAINER_TAGS = "article main div td body".split()
