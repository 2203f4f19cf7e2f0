"""The meters, as fixed values."""

# Transliterated name and groups of each meter, verse quarters divided by /. Order matters: of
# meters that fit equally, the first is named.
METERS = (
    ("śrī", "ga"),
    ("strī", "ga-ga"),
    ("mṛgī", "ra"),
    ("nārī", "ma"),
    ("kanyā", "ma-ga"),
    ("paṅkti", "bha-ga-ga"),
    ("tanumadhyā", "ta-ya"),
    ("vasumatī", "ta-sa"),
    ("śaśivadanā", "na-ya"),
    ("haṃsamālā", "sa-ra-ga"),
    ("kumāralalitā", "ja-sa-ga"),
    ("madalekhā", "ma-sa-ga"),
    ("madhumatī", "na-na-ga"),
    ("citrapadā", "bha-bha-ga-ga"),
    ("haṃsaruta", "ma-na-ga-ga"),
    ("māṇavaka", "bha-ta-la-ga"),
    ("nārācaka", "ta-ra-la-ga"),
    ("pramāṇikā", "ja-ra-la-ga"),
    ("samānikā", "ra-ja-ga-la"),
    ("vidyunmālā", "ma-ma-ga-ga"),
    ("bhujagaśiśubhṛtā", "na-na-ma"),
    ("halamukhī", "ra-na-sa"),
    ("campakamālā", "bha-ma-sa-ga"),
    ("manoramā", "na-ra-ja-ga"),
    ("mattā", "ma-bha-sa-ga"),
    ("mayūrasāriṇī", "ra-ja-ra-ga"),
    ("paṇava", "ma-na-ya-ga"),
    ("rukmavatī", "bha-ma-sa-ga"),
    ("upasthitā", "ta-ja-ja-ga"),
    ("śuddhavirāṭ", "ma-sa-ja-ga"),
    ("bhadrikā", "na-na-ra-la-ga"),
    ("bhramaravilasitaṃ", "ma-bha-na-la-ga"),
    ("dodhaka", "bha-bha-bha-ga-ga"),
    ("indravajrā", "ta-ta-ja-ga-ga"),
    ("mauktikamālā", "bha-bha-ta-la-ga"),
    ("rathoddhatā", "ra-na-ra-la-ga"),
    ("sumukhī", "na-ja-ja-la-ga"),
    ("svāgatā", "ra-na-bha-ga-ga"),
    ("sāndrapada", "bha-ta-na-ga-ga"),
    ("upasthita", "ja-sa-ta-ga-ga"),
    ("upendravajrā", "ja-ta-ja-ga-ga"),
    ("vātormī", "ma-bha-ta-ga-ga"),
    ("vṛntā", "na-na-sa-ga-ga"),
    ("śikhaṇḍita", "ja-sa-ta-ga-ga"),
    ("śrī", "bha-ta-na-ga-ga"),
    ("śyenikā", "ra-ja-ra-la-ga"),
    ("śālinī", "ma-ta-ta-ga-ga"),
    ("bhujaṅgaprayāta", "ya-ya-ya-ya"),
    ("candravartma", "ra-na-bha-sa"),
    ("drutavilambita", "na-bha-bha-ra"),
    ("indravaṃśā", "ta-ta-ja-ra"),
    ("jaladharamālā", "ma-bha-sa-ma"),
    ("jaloddhatagati", "ja-sa-ja-sa"),
    ("kusumavicitrā", "na-ya-na-ya"),
    ("lalitā", "ta-bha-ja-ra"),
    ("mauktidadāma", "ja-ja-ja-ja"),
    ("maṇimālā", "ta-ya-ta-ya"),
    ("mālatī", "na-ja-ja-ra"),
    ("navamālinī", "na-ja-bha-ya"),
    ("pañcacāmara", "ja-ra-ja-ra-ja-ga"),
    ("prabhā", "na-na-ra-ra"),
    ("pramitākṣarā", "sa-ja-sa-sa"),
    ("pramuditavadanā", "na-na-ra-ra"),
    ("priyaṃvadā", "na-bha-ja-ra"),
    ("puṭa", "na-na-ma-ya"),
    ("sragviṇī", "ra-ra-ra-ra"),
    ("toṭaka", "sa-sa-sa-sa"),
    ("tāmarasa", "na-ja-ja-ya"),
    ("ujjvalā", "na-na-bha-ra"),
    ("vaiśvadevī", "ma-ma-ya-ya"),
    ("vaṃśastha", "ja-ta-ja-ra"),
    ("candrikā", "na-na-ta-ra-ga"),
    ("kṣamā", "na-na-ta-ta-ga"),
    ("mattamayūra", "ma-ta-ya-sa-ga"),
    ("mañjubhāṣiṇī", "sa-ja-sa-ja-ga"),
    ("nandinī", "sa-ja-sa-sa-ga"),
    ("praharṣiṇī", "ma-na-ja-ra-ga"),
    ("rucirā", "ja-bha-sa-ja-ga"),
    ("alolā", "ma-sa-ma-bha-ga-ga"),
    ("aparājitā", "na-na-ra-sa-la-ga"),
    ("asambādhā", "ma-ta-na-sa-ga-ga"),
    ("induvadanā", "bha-ja-sa-na-ga-ga"),
    ("praharaṇakalikā", "na-na-bha-na-la-ga"),
    ("vasantatilakā", "ta-bha-ja-ja-ga-ga"),
    ("candralekhā", "ma-ra-ma-ya-ya"),
    ("elā", "sa-ja-na-na-ya"),
    ("mālinī", "na-na-ma-ya-ya"),
    ("maṇiguṇanikara", "na-na-na-na-sa"),
    ("mālā", "na-na-na-na-sa"),
    ("prabhadraka", "na-ja-bha-ja-ra"),
    ("śaśikalā", "na-na-na-na-sa"),
    ("vāṇinī", "na-ja-bha-ja-ra-ga"),
    ("ṛṣabhagajavilasita", "bha-ra-na-na-na-ga"),
    ("hariṇī", "na-sa-ma-ra-sa-la-ga"),
    ("kokilaka", "na-ja-bha-ja-ja-la-ga"),
    ("mandākrāntā", "ma-bha-na-ta-ta-ga-ga"),
    ("narkuṭaka", "na-ja-bha-ja-ja-la-ga"),
    ("pṛthvī", "ja-sa-ja-sa-ya-la-ga"),
    ("vaṃśapatrapatitam", "bha-ra-na-bha-na-la-ga"),
    ("śikhariṇī", "ya-ma-na-sa-bha-la-ga"),
    ("kusumitalatāvellitā", "ma-ta-na-ya-ya-ya"),
    ("meghavisphurjita", "ya-ma-na-sa-ra-ra-ga"),
    ("śārdūlavikrīḍita", "ma-sa-ja-sa-ta-ta-ga"),
    ("suvadanā", "ma-ra-bha-na-ya-bha-la-ga"),
    ("vṛtta", "ra-ja-ra-ja-ra-ja-ga-la"),
    ("bhadravirāṭ", "ta-ja-ra-ga/ma-sa-ja-ga"),
    ("sragdharā", "ma-ra-bha-na-ya-ya-ya"),
    ("ketumatī", "sa-ja-sa-ga/bha-ra-na-ga-ga"),
    ("madraka", "bha-ra-na-ra-na-ra-na-ga"),
    ("aśvalalita", "na-ja-bha-ja-bha-ja-bha-la-ga"),
    ("mattākrīḍa", "ma-ma-ta-na-na-na-na-la-ga"),
    ("upacitrā", "sa-sa-sa-la-ga/bha-bha-bha-ga-ga"),
    ("viparītākhyānikī", "ja-ta-ja-ga-ga/ta-ta-ja-ga-ga"),
    ("ākhyānikī", "ta-ta-ja-ga-ga/ja-ta-ja-ga-ga"),
    ("aparavaktra", "na-na-ra-la-ga/na-ja-ja-ra"),
    ("drutamadhyā", "bha-bha-bha-ga-ga/na-ja-ja-ya"),
    ("hariṇaplutā", "sa-sa-sa-la-ga/na-bha-bha-ra"),
    ("tanvī", "bha-ta-na-sa-bha-bha-na-ya"),
    ("krauñcapadā", "bha-ma-sa-bha-na-na-na-na-ga"),
    ("vegavatī", "sa-sa-sa-sa-ga/bha-bha-bha-ga-ga"),
    ("yavātparāmatīya", "ra-ja-ra-ja/ja-ra-ja-ra"),
    ("apavāha", "ma-na-na-na-na-na-na-sa-ga-ga"),
    ("bhujaṅgavijṛmbhita", "ma-ma-ta-na-na-na-ra-sa-la-ga"),
    ("puṣpitāgrā", "na-na-ra-ya/na-ja-ja-ra-ga"),
    ("caṇḍavṛṣṭiprayātadaṇḍaka", "na-na-ra-ra-ra-ra-ra-ra-ra"),
    ("pracitakadaṇḍaka", "na-na-ya-ya-ya-ya-ya-ya-ya"),
    ("arṇadaṇḍaka", "na-na-ra-ra-ra-ra-ra-ra-ra-ra"),
    ("arṇavadaṇḍaka", "na-na-ra-ra-ra-ra-ra-ra-ra-ra-ra"),
    ("vyāladaṇḍaka", "na-na-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra"),
    ("jīmūtadaṇḍaka", "na-na-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra"),
    ("līlākaradaṇḍaka", "na-na-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra"),
    ("uddāmadaṇḍaka", "na-na-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra"),
    ("saurabhaka", "sa-ja-sa-la/na-sa-ja-ga/ra-na-bha-ga/sa-ja-sa-ja-ga"),
    ("udgatā", "sa-ja-sa-la/na-sa-ja-ga/bha-na-ja-la-ga/sa-ja-sa-ja-ga"),
    ("lalita", "sa-ja-sa-la/na-sa-ja-ga/na-na-sa-sa/sa-ja-sa-ja-ga"),
    ("śaṅkhadaṇḍaka", "na-na-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra"),
    ("samudradaṇḍaka", "na-na-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra"),
    ("bhujaṅgadaṇḍaka", "na-na-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra-ra"),
    ("upasthitapracupita", "ma-sa-ja-bha-ga-ga/sa-na-ja-ra-ga/na-na-sa/na-na-na-ja-ya"),
    ("vardhamāna", "ma-sa-ja-bha-ga-ga/sa-na-ja-ra-ga/na-sa-na/na-na-na-ja-ya"),
    ("śuddhavirāḍārṣabha", "ma-sa-ja-bha-ga-ga/sa-na-ja-ra-ga/ta-ja-ra/na-na-na-ja-ya"),
    ("kalikā", "na-na-na-ya/na-na-ga-ga/na-na-na-na-ya/na-na-na-na-na-na-ga-ga"),
    ("amṛtadhārā", "na-na-na-ya/na-na-na-na-sa-ga/na-na-na-na-na-na-ga-ga/na-na-ga-ga"),
    ("lavalī", "na-na-na-ya/na-na-na-na-sa-ga/na-na-ga-ga/na-na-na-na-na-na-ga-ga"),
    ("āpīḍa", "na-na-ga-ga/na-na-na-ya/na-na-na-na-sa-ga/na-na-na-na-na-na-ga-ga"),
)
# Syllables of a group; L is light, G is heavy.
GANAS = {"ya": "LGG", "ma": "GGG", "ta": "GGL", "ra": "GLG", "ja": "LGL", "bha": "GLL", "na": "LLL", "sa": "LLG", "la": "L", "ga": "G"}
# Morae of the quarters.
JATIS = {"āryā": (12, 18, 12, 15)}


def pattern(groups: str) -> str:
    """Weights of all quarters, divided by /."""
    return "/".join("".join(GANAS[g] for g in q.split("-")) for q in groups.split("/"))


#: (ord, name, groups, pattern)
ROWS = [(k, name, groups, pattern(groups)) for k, (name, groups) in enumerate(METERS)]
