"""Letters of the phoneme encoding (one character a phoneme) and of its romanisation."""

# Fixed values of the encoding.
VOWELS = "aAiIuUfFxXeEoO"
LONG_VOWELS = "AIUFXeEoO"
CONSONANTS = "kKgGNcCjJYwWqQRtTdDnpPbBmyrlvSzsh"
MARKS = "MH'"
LETTERS = VOWELS + CONSONANTS + MARKS
VOICED = "gGNjJYqQRdDnbBmyrlvh"

# Romanisation to phonemes; two letters first.
ROMAN = {
    "kh": "K", "gh": "G", "ch": "C", "jh": "J", "ṭh": "W", "ḍh": "Q", "th": "T", "dh": "D", "ph": "P", "bh": "B", "ai": "E", "au": "O",
    "ā": "A", "ī": "I", "ū": "U", "ṛ": "f", "ṝ": "F", "ḷ": "x", "ḹ": "X", "ē": "e", "ō": "o", "ś": "S", "ṣ": "z", "ṅ": "N", "ñ": "Y", "ṇ": "R",
    "ṭ": "w", "ḍ": "q", "ṃ": "M", "ṁ": "M", "ḥ": "H", "w": "v", "'": "'", "’": "'", "‘": "'", "ʼ": "'",
    **{c: c for c in "aiueokgcjtdnpbmyrlvsh"},
}
BREAKS = "|।॥"

# The native script.
NATIVE_VOWELS = dict(zip("अआइईउऊऋॠऌॡएऐओऔ", VOWELS[:10] + "eEoO", strict=True))
NATIVE_SIGNS = dict(zip("ािीुूृॄॢॣेैोौ", "AiIuUfFxXeEoO", strict=True))
NATIVE_CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह", CONSONANTS, strict=True))
NATIVE_CONSONANTS["ळ"] = "l"
NATIVE_MARKS = {"ं": "M", "ँ": "M", "ः": "H", "ऽ": "'"}
VIRAMA = "्"

# Control tokens of the training text, in id order, before the characters.
CORE = ("<pad>", "<bos>", "<eos>", "<sep>", "<unk>")
TASKS = ("<seg>", "<morph>", "<sandhi>", "<denoise>", "<Candas>")
FEATURES = ("<dhAtu>", "<gaRa>", "<lakAra>", "<puruza>", "<vacana>", "<viBakti>", "<liNga>", "<prayoga>", "<kft>", "<taddhita>", "<artha>", "<meter>", "<wt>")
MASKS = tuple(f"[MASK_{k}]" for k in range(32))
CONTROLS = CORE + TASKS + FEATURES + MASKS
CHARACTERS = VOWELS + CONSONANTS + MARKS + "\\^~L|" + "0123456789" + " .,-"
VOCABULARY = {t: k for k, t in enumerate([*CONTROLS, *dict.fromkeys(CHARACTERS)])}
