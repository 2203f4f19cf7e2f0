"""Queries on corpus hygiene, roots, script forms, golden verses, prepared training sets, evaluation reports."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import kernels as K
from ..functions import text as X
from ..operators import prosody, sandhi
from ..sources import readers
from ..sources.readers import once
from . import duck as D
from . import registry as R
from .registry import query

# --- script forms -----------------------------------------------------------------------------------------
# Lines in the native script, in the encoding and in composed and decomposed romanisation.
FORMS = (
    (1, "धर्मक्षेत्रे कुरुक्षेत्रे समवेता युयुत्सवः"), (2, "हँस चाँद"), (3, "अग्निमीळे पुरोहितं"), (4, "रामोऽस्ति। वनम्॥ जलं"), (5, "ॐ कॄ ऌ"), (6, ""), (7, "rAmo'sti vanam"),
    (8, "kṛṣṇaḥ pārvatī ṝ ḷ ṃ"), (9, unicodedata.normalize("NFD", "kṛṣṇaḥ pārvatī ṝ ḷ ṃ ñ ś")), (10, "॥ । |"), (11, "क्\nत"),
)
_CONS, _SIGNS = "".join(A.NATIVE_CONSONANTS), "".join(A.NATIVE_SIGNS)
_NATIVE = D.mapping(A.NATIVE_VOWELS | A.NATIVE_SIGNS | A.NATIVE_CONSONANTS | A.NATIVE_MARKS | {b: "\n" for b in A.BREAKS} | {"\n": "\n", A.VIRAMA: ""})
_FORM = f"""native AS (SELECT id, text, array_to_string(list_transform(regexp_extract_all(text, '(?s)[{_CONS}][{_SIGNS}{A.VIRAMA}]?|.'), lambda p:
coalesce(map_extract_value({_NATIVE}, p[1]), CASE WHEN regexp_matches(p[1], '\\s') THEN ' ' ELSE '' END) || CASE WHEN regexp_matches(p, '^[{_CONS}]') THEN CASE WHEN length(p) = 1 THEN 'a' ELSE coalesce(map_extract_value({_NATIVE}, p[2]), '') END ELSE '' END), '') AS n FROM forms),
said AS (SELECT id, CASE WHEN regexp_matches(text, '[{''.join([*A.NATIVE_VOWELS, *A.NATIVE_SIGNS, *A.NATIVE_CONSONANTS])}]') THEN {D.norm('n')} ELSE {D.phonemes('nfc_normalize(text)')} END AS phonemes FROM native)"""


@query(f"WITH {D.values('forms', 'id, text', FORMS)}, {_FORM} SELECT id, phonemes, {D.weights('phonemes')} AS w FROM said")
def translit_forms(spark, sf_dir):
    """Every script and both Unicode forms, with the weights."""
    p = spark.createDataFrame(FORMS, "id long, text string").select("id", X.to_phonemes(F.col("text")).alias("phonemes"))
    return p.select("id", "phonemes", X.weights(F.col("phonemes")).alias("w"))


# --- golden verses ------------------------------------------------------------------------------------------
# Well-known verses with their meters; the last one has none.
GOLDEN = (
    (1, "anuṣṭubh", "tapaḥsvādhyāyanirataṃ\ntapasvī vāgvidāṃ varam\nnāradaṃ paripapraccha\nvālmīkir munipuṅgavam"),
    (2, "anuṣṭubh", "vāgarthāviva saṃpṛktau\nvāgarthapratipattaye\njagataḥ pitarau vande\npārvatīparameśvarau"),
    (3, "anuṣṭubh", "karmaṇyevādhikāraste\nmā phaleṣu kadācana\nmā karmaphalaheturbhūr\nmā te saṅgo'stvakarmaṇi"),
    (4, "indravajrā", "vedeṣu yajñeṣu tapaḥsu caiva\ndāneṣu yatpuṇyaphalaṃ pradiṣṭam\natyeti tatsarvamidaṃ viditvā\nyogī paraṃ sthānamupaiti cādyam"),
    (5, "indravajrā", "nirmānamohā jitasaṅgadoṣā\nadhyātmanityā vinivṛttakāmāḥ\ndvandvairvimuktāḥ sukhaduḥkhasaṃjñair\ngacchantyamūḍhāḥ padamavyayaṃ tat"),
    (6, "upendravajrā", "yathā nadīnāṃ bahavo'mbuvegāḥ\nsamudramevābhimukhā dravanti\ntathā tavāmī naralokavīrā\nviśanti vaktrāṇyabhivijvalanti"),
    (7, "upajāti", "vāsāṃsi jīrṇāni yathā vihāya\nnavāni gṛhṇāti naro'parāṇi\ntathā śarīrāṇi vihāya jīrṇāny\nanyāni saṃyāti navāni dehī"),
    (8, "upajāti", "astyuttarasyāṃ diśi devatātmā\nhimālayo nāma nagādhirājaḥ\npūrvāparau toyanidhī vagāhya\nsthitaḥ pṛthivyā iva mānadaṇḍaḥ"),
    (9, "mandākrāntā", "kaścit kāntāvirahaguruṇā svādhikārapramattaḥ\nśāpenāstaṃgamitamahimā varṣabhogyeṇa bhartuḥ\nyakṣaścakre janakatanayāsnānapuṇyodakeṣu\nsnigdhacchāyātaruṣu vasatiṃ rāmagiryāśrameṣu"),
    (10, "mandākrāntā", "śāntākāraṃ bhujagaśayanaṃ padmanābhaṃ sureśaṃ\nviśvādhāraṃ gaganasadṛśaṃ meghavarṇaṃ śubhāṅgam\nlakṣmīkāntaṃ kamalanayanaṃ yogibhirdhyānagamyaṃ\nvande viṣṇuṃ bhavabhayaharaṃ sarvalokaikanātham"),
    (11, "śārdūlavikrīḍita", "yā kundendutuṣārahāradhavalā yā śubhravastrāvṛtā\nyā vīṇāvaradaṇḍamaṇḍitakarā yā śvetapadmāsanā\nyā brahmācyutaśaṅkaraprabhṛtibhirdevaiḥ sadā vanditā\nsā māṃ pātu sarasvatī bhagavatī niḥśeṣajāḍyāpahā"),
    (12, "śārdūlavikrīḍita", "kastūrītilakaṃ lalāṭaphalake vakṣaḥsthale kaustubhaṃ\nnāsāgre varamauktikaṃ karatale veṇuṃ kare kaṅkaṇam\nsarvāṅge haricandanaṃ sulalitaṃ kaṇṭhe ca muktāvalī\ngopastrīpariveṣṭito vijayate gopālacūḍāmaṇiḥ"),
    (13, "vasantatilakā", "yāṃ cintayāmi satataṃ mayi sā viraktā\nsāpyanyamicchati janaṃ sa jano'nyasaktaḥ\nasmatkṛte ca pariśuṣyati kācidanyā\ndhiktāṃ ca taṃ ca madanaṃ ca imāṃ ca māṃ ca"),
    (14, "śikhariṇī", "mahimnaḥ pāraṃ te paramaviduṣo yadyasadṛśī\nstutirbrahmādīnāmapi tadavasannāstvayi giraḥ\nathāvācyaḥ sarvaḥ svamatipariṇāmāvadhi gṛṇan\nmamāpyeṣa stotre hara nirapavādaḥ parikaraḥ"),
    (15, "mālinī", "bhagavati tava tīre nīramātrāśano'haṃ\nvigataviṣayatṛṣṇaḥ kṛṣṇamārādhayāmi\nsakalakaluṣabhaṅge svargasopānasaṅge\ntaralatarataraṅge devi gaṅge prasīda"),
    (16, "bhujaṅgaprayāta", "manobuddhyahaṅkāracittāni nāhaṃ\nna ca śrotrajihve na ca ghrāṇanetre\nna ca vyoma bhūmirna tejo na vāyuḥ\ncidānandarūpaḥ śivo'haṃ śivo'ham"),
    (17, "pañcacāmara", "jaṭāṭavīgalajjalapravāhapāvitasthale\ngalevalambya lambitāṃ bhujaṅgatuṅgamālikām\nḍamaḍḍamaḍḍamaḍḍamannināda vaḍḍamarvayaṃ\ncakāra caṇḍatāṇḍavaṃ tanotu naḥ śivaḥ śivam"),
    (18, "sragdharā", "yā sṛṣṭiḥ sraṣṭurādyā vahati vidhihutaṃ yā havir yā ca hotrī\nye dve kālaṃ vidhattaḥ śrutiviṣayaguṇā yā sthitā vyāpya viśvam\nyāmāhuḥ sarvabījaprakṛtiriti yayā prāṇinaḥ prāṇavantaḥ\npratyakṣābhiḥ prapannastanubhiravatu vastābhiraṣṭābhirīśaḥ"),
    (19, "āryā", "dṛṣṭavadānuśravikaḥ sa hyaviśuddhikṣayātiśayayuktaḥ\ntadviparītaḥ śreyānvyaktāvyaktajñavijñānāt"),
    (20, "āryā", "duḥkhatrayābhighātājjijñāsā tadapaghātake hetau\ndṛṣṭe sāpārthā cennaikāntātyantato'bhāvāt"),
    (21, None, "kālo'smi lokakṣayakṛtpravṛddho\nlokānsamāhartumiha pravṛttaḥ\nṛte'pi tvāṃ na bhaviṣyanti sarve\nye'vasthitāḥ pratyanīkeṣu yodhāḥ"),
)
_GOLD = D.values("gold", "id, meter, text", GOLDEN)


@query(f"""WITH {D.meters()}, {_GOLD}, {D.lines('gold', 'id')}, padas AS (SELECT id, pos, {D.weights('line')} AS w FROM lines), flats AS (SELECT id, string_agg(w, '' ORDER BY pos) AS flat FROM padas GROUP BY id),
{R._VRTTA}, {R._FAMILIES}, {R._ANUSTUBH}, {R._JATI}, g AS (SELECT id, min(substr(w, 2, length(w) - 2)) AS t, min(length(w)) AS n FROM padas GROUP BY id HAVING count(*) >= 2 AND count(DISTINCT length(w)) = 1 AND count(DISTINCT left(w, 1)) >= 2 AND min(substr(w, 2, length(w) - 2)) = max(substr(w, 2, length(w) - 2))),
up AS (SELECT id, arg_min(members, first_ord) AS mix FROM g JOIN fam ON left(tail, length(tail) - 1) = t AND length(tail) = n - 1 GROUP BY id),
found AS (SELECT gold.id, meter, CASE WHEN label IS NOT NULL THEN 'anuṣṭubh' WHEN o.name IS NOT NULL THEN o.name WHEN mix IS NOT NULL THEN 'upajāti' WHEN h.name IS NOT NULL THEN h.name WHEN ok THEN 'āryā' END AS found
FROM gold LEFT JOIN an USING (id) LEFT JOIN jt USING (id) LEFT JOIN up USING (id) LEFT JOIN (SELECT * FROM v WHERE one) o USING (id) LEFT JOIN (SELECT * FROM v WHERE NOT one) h USING (id))
SELECT id, meter, found, meter IS NOT DISTINCT FROM found AS right_one FROM found""")
def golden_verses(spark, sf_dir):
    """Whether the cascade names the meters of well-known verses."""
    gold = spark.createDataFrame(GOLDEN, "id long, meter string, text string")
    return gold.join(prosody.scan(gold).select("id", F.col("meter_name").alias("found")), "id").select("id", "meter", "found", F.col("meter").eqNullSafe(F.col("found")).alias("right_one"))


@query(f"""WITH {D.meters()}, {_GOLD}, {D.lines('gold', 'id')}, padas AS (SELECT id, pos, {D.weights('line')} AS w FROM lines), {R._FAMILIES},
g AS (SELECT id, min(substr(w, 2, length(w) - 2)) AS t, min(length(w)) AS n FROM padas GROUP BY id HAVING count(*) >= 2 AND count(DISTINCT length(w)) = 1 AND count(DISTINCT left(w, 1)) >= 2 AND min(substr(w, 2, length(w) - 2)) = max(substr(w, 2, length(w) - 2)))
SELECT id, arg_min(members, first_ord) AS members FROM g JOIN fam ON left(tail, length(tail) - 1) = t AND length(tail) = n - 1 GROUP BY id""")
def golden_upajati(spark, sf_dir):
    """The mixed meters among the well-known verses."""
    lines = R.lines(spark.createDataFrame(GOLDEN, "id long, meter string, text string"), "id")
    return prosody.upajati(lines.select("id", "pos", X.weights(F.col("line")).alias("w")), "id")


# What another classifier says of some verses, by its own names, and where it is known to differ.
OTHER = ((1, "anustup"), (4, "indravajra"), (6, "upendravajra"), (7, "upajati"), (13, "vasantatilaka"), (15, "malini"), (19, "arya"), (20, "gitih"), (21, "upajati"))
ALIASES = {"anustup": "anuṣṭubh", "indravajra": "indravajrā", "upendravajra": "upendravajrā", "upajati": "upajāti", "vasantatilaka": "vasantatilakā", "malini": "mālinī", "arya": "āryā"}
KNOWN = (20, 21)


@query(f"""WITH {D.values('other', 'id, said', OTHER)}, {_GOLD} SELECT id, said, coalesce(map_extract_value({D.mapping(ALIASES)}, said), said) IS NOT DISTINCT FROM meter AS agrees, id IN {KNOWN} AS expected_to_differ FROM other JOIN gold USING (id)""")
def meter_cross_check(spark, sf_dir):
    """Two classifiers on the same verses, the other's names mapped to ours."""
    found = golden_verses(spark, sf_dir).select("id", F.col("found").alias("ours"))
    other = spark.createDataFrame(OTHER, "id long, said string")
    theirs = F.coalesce(F.try_element_at(X.lookup(ALIASES), F.col("said")), F.col("said"))
    return other.join(found, "id").select("id", "said", theirs.eqNullSafe(F.col("ours")).alias("agrees"), F.col("id").isin(*KNOWN).alias("expected_to_differ"))


# --- corpus hygiene -----------------------------------------------------------------------------------------
_PADA = f"list_filter(list_transform(string_split(line, ' '), lambda p: trim(p, '''|')), lambda p: length(p) >= 2 AND regexp_matches(p, {D.q(f'^[{A.LETTERS}L]+$')}))"


@query(f"WITH {D.lines('documents', 'doc_id')}, c AS (SELECT doc_id, pos, {_PADA} AS ps FROM lines) SELECT doc_id, pos, len(ps) AS n_padas, array_to_string(ps, ' ') AS padas FROM c WHERE len(ps) >= 2")
def clean_slokas(spark, sf_dir):
    """Lines with two clean words and more."""
    return R.by_kernel(R.table(spark, sf_dir, "documents"), K.cleaned, "doc_id long, pos long, n_padas long, padas string", "doc_id")


@query(f"""WITH {D.lines('benchmark', 'item_id')}, w AS (SELECT item_id, unnest({_PADA}) AS pada FROM lines), c AS (SELECT DISTINCT item_id, pada FROM w WHERE length(pada) >= 4)
SELECT item_id, count(*) AS n_lines, max(length(pada)) AS longest FROM c GROUP BY item_id""")
def clean_lines(spark, sf_dir):
    """Clean lines of four letters and more; here each word is a line of its own."""
    l = R.words(R.table(spark, sf_dir, "benchmark"), "item_id").select("item_id", X.clean_pada(F.col("word")).alias("pada")).filter("length(pada) >= 4").distinct()
    return l.groupBy("item_id").agg(F.count("*").alias("n_lines"), F.max(F.char_length("pada")).cast("long").alias("longest"))


# Nested documents as they may come, with parts missing.
NESTED = tuple((k, json.dumps(d, ensure_ascii=False)) for k, d in enumerate((
    {"sections": [{"blocks": [{"content": "atha yogAnuSAsanam"}, {"content": None}, {}]}, {"blocks": []}, {}]}, {"sections": None}, {}, {"sections": [{"blocks": [{"content": "yogaS cittavftti", "extra": 1}]}]},
)))


@query(f"""WITH {D.values('nested', 'id, doc', NESTED)}, s AS (SELECT id, unnest(CASE WHEN coalesce(json_array_length(doc, '$.sections'), 0) = 0 THEN ['{{}}'] ELSE (doc::JSON->'$.sections[*]')::VARCHAR[] END) AS s FROM nested),
b AS (SELECT id, unnest(CASE WHEN coalesce(json_array_length(s, '$.blocks'), 0) = 0 THEN ['{{}}'] ELSE (s::JSON->'$.blocks[*]')::VARCHAR[] END) AS b FROM s) SELECT id, coalesce(b::JSON->>'$.content', '') AS content FROM b""")
def nested_json_blocks(spark, sf_dir):
    """The content of every block of nested documents; missing parts are empty."""
    doc = spark.createDataFrame(NESTED, "id long, doc string").select("id", F.from_json("doc", readers.SECTIONS).alias("d"))
    blocks = doc.select("id", F.explode_outer("d.sections").alias("s")).select("id", F.explode_outer("s.blocks").alias("b"))
    return blocks.select("id", F.coalesce("b.content", F.lit("")).alias("content"))


# --- roots ----------------------------------------------------------------------------------------------------
# Roots as they are taught, with markers: code, class, form, meaning.
ROOT_FORMS = (
    ("01.0001", "1", "BU", "sattAyAm"), ("01.0002", "1", "eDa~\\", "vfdDO"), ("01.1136", "1", "vada~", "vyaktAyAM vAci"), ("01.1137", "1", "gamx~", "gatO"), ("01.1151", "1", "qupaca~^z", "pAke"),
    ("01.1049", "1", "RI\\Y", "prApaRe"), ("01.0982", "1", "sf\\", "gatO"), ("01.1167", "1", "vaha~^", "prApaRe"), ("02.0001", "2", "ada~\\", "BakzaRe"), ("02.0002", "2", "hana~\\", "hiMsAgatyoH"),
    ("02.0040", "2", "i\\R", "gatO"), ("02.0059", "2", "vida~", "jYAne"), ("02.0060", "2", "asa~", "Buvi"), ("03.0001", "3", "hu\\", "dAnAdanayoH"), ("03.0008", "3", "o~hA\\N", "gatO"), ("03.0009", "3", "o~hA\\k", "tyAge"),
    ("03.0010", "3", "qudA\\Y", "dAne"), ("04.0001", "4", "divu~", "krIqAyAm"), ("04.0067", "4", "vida~\\", "sattAyAm"), ("04.0106", "4", "asu~", "kzepaRe"), ("05.0001", "5", "zu\\Y", "aBizave"), ("06.0001", "6", "tuda~^", "vyaTane"),
    ("06.0168", "6", "vidx~^", "lABe"), ("07.0013", "7", "vida~\\", "vicAraRe"), ("07.0001", "7", "ruDi~^r", "AvaraRe"), ("08.0010", "8", "qukf\\Y", "karaRe"), ("09.0001", "9", "qukrI\\Y", "dravyavinimaye"), ("10.0001", "10", "cura~", "steye"), ("10.0002", "10", "GuRa~", "BramaRe"), ("99.0001", "1", "~", ""),
)
_BARE = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(form, '[\\\\^]', '', 'g'), '[{A.CONSONANTS}]$', ''), '[{A.VOWELS}]~', '', 'g'), '^(Yi|wu|qu)', '')"
_ROOTS = f"{D.values('forms', 'code, gana, form, artha', ROOT_FORMS)}, roots AS (SELECT code, gana, form, artha, {_BARE} AS root FROM forms)"


def roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROOT_FORMS, "code string, gana string, form string, artha string").withColumn("root", X.bare_root(F.col("form")))


@query(f"WITH {_ROOTS} SELECT 'morph' AS task, '<morph>' || root AS src, '<dhAtu>' || form || '<gaRa>' || gana || '<artha>' || artha AS tgt, 'dhatupatha:' || code AS provenance FROM roots WHERE regexp_matches(root, '[{A.VOWELS}]')")
def morph_examples(spark, sf_dir):
    """An example for each root; those of which nothing is left without markers go."""
    r = roots(spark).filter(F.col("root").rlike(f"[{A.VOWELS}]"))
    return r.select(F.lit("morph").alias("task"), F.concat(F.lit("<morph>"), "root").alias("src"), F.concat(F.lit("<dhAtu>"), "form", F.lit("<gaRa>"), "gana", F.lit("<artha>"), "artha").alias("tgt"), F.concat(F.lit("dhatupatha:"), "code").alias("provenance"))


@query(f"""WITH {_ROOTS}, asked AS (SELECT DISTINCT word FROM (SELECT unnest(['BU', 'vid', 'hA', 'as', 'zzzq']) AS word)), hit AS (SELECT word, code, gana, artha, row_number() OVER (PARTITION BY word ORDER BY code) AS k FROM asked JOIN roots ON root = word)
SELECT word, code, gana, artha, k FROM hit WHERE k <= 5""")
def root_lookup(spark, sf_dir):
    """All entries of a root, five at most: a form without markers may have several."""
    asked = spark.createDataFrame([(w,) for w in ("BU", "vid", "hA", "as", "zzzq")], "word string")
    hit = asked.join(F.broadcast(roots(spark)), F.col("word") == F.col("root"))  # a fixed table
    return hit.withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy("code")).cast("long")).filter("k <= 5").select("word", "code", "gana", "artha", "k")


# --- rule coverage with carriers, windows of two to four words ------------------------------------------------
# What stands before and after a junction.
BEFORE, AFTER = ("r", "m", "d", "s", "gr", "str", "rAm", "dev"), ("ma", "na", "ka", "ya", "sya", "ti", "H", "m")
_CARRIED = f"""cover AS (SELECT ord, k, ({list(BEFORE)})[1 + (ord * 7 + k * 3) % {len(BEFORE)}] || first AS a, second || ({list(AFTER)})[1 + (ord * 5 + k) % {len(AFTER)}] AS b FROM rules, (SELECT unnest(range(0, 3)) AS k) WHERE first <> '' AND second <> ''),
pairs AS (SELECT DISTINCT a, b FROM cover)"""


@query(f"WITH {D.rules()}, {_CARRIED}, {D.joined()} SELECT c.ord, k, '<sandhi>' || c.a || '<sep>' || c.b AS src, replace(joined, ' ', '') AS tgt, 'rule-cover:' || category AS provenance FROM cover c JOIN j ON j.a = c.a AND j.b = c.b AND cand = 1")
def rule_cover_examples(spark, sf_dir):
    """Three examples of every rule, with carriers that differ."""
    pick = lambda xs, k: F.get(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int"))
    r = sandhi.rules(spark).filter("first <> '' and second <> ''").select("ord", "first", "second", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    r = r.select("ord", F.col("k").cast("long").alias("k"), F.concat(pick(BEFORE, F.col("ord") * 7 + F.col("k") * 3), "first").alias("a"), F.concat("second", pick(AFTER, F.col("ord") * 5 + F.col("k"))).alias("b"))
    r = sandhi.fold(r, "a", "b", "joined", "category")
    return r.select("ord", "k", F.concat(F.lit("<sandhi>"), "a", F.lit("<sep>"), "b").alias("src"), F.replace("joined", F.lit(" "), F.lit("")).alias("tgt"), F.concat(F.lit("rule-cover:"), "category").alias("provenance"))


@query(f"""WITH {D.lines('documents', 'doc_id')}, w AS (SELECT doc_id, pos, string_split(line, ' ') AS ws FROM lines), x AS (SELECT doc_id, pos, width, unnest(range(1, len(ws) - width + 2)) AS start, ws FROM w, (SELECT unnest([2, 3, 4]) AS width))
SELECT doc_id, pos, width, start, array_to_string(ws[start : start + width - 1], '') AS src, array_to_string(ws[start : start + width - 1], ' | ') AS tgt FROM x WHERE length(array_to_string(ws[start : start + width - 1], '')) <= 60""")
def seg_windows_all(spark, sf_dir):
    """Windows of two, three and four words."""
    return R.seg_rows(R.table(spark, sf_dir, "documents"), 2, 3, 4)


# --- prepared sets ----------------------------------------------------------------------------------------------
BLOCK, SHARE = 1024, 0.05
_READY = f"""{R._TURNS}, k AS (SELECT conv_id, turn, src, tgt, length(src) + length(tgt) + 3 AS n_ids, length(src) + 2 AS loss_start, CASE WHEN contains(src, '?') THEN 'ask' ELSE 'say' END AS task FROM e WHERE length(src) + length(tgt) + 3 <= {BLOCK}),
o AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY md5('1337:' || conv_id || ':' || turn), conv_id, turn) AS r, count(*) OVER (PARTITION BY task) AS n FROM k),
ready AS (SELECT *, CASE WHEN r <= greatest(1, floor(n * {SHARE}::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM o)"""


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, task, ids, loss_start, split): encoded examples that fit a block, five in a hundred of each task held back."""
    ids, start = X.encode_example(F.col("src"), F.col("tgt"))
    e = R._turns(spark, sf_dir).select("conv_id", "turn", F.when(F.col("src").contains("?"), "ask").otherwise("say").alias("task"), ids.alias("ids"), start.cast("int").alias("loss_start")).filter(F.size("ids") <= BLOCK)
    e = e.withColumn("h", F.md5(F.concat(F.lit("1337:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")))).withColumn("b", F.substring("h", 1, 3))
    e = once(e, "encoded")
    bins = e.groupBy("task", "b").agg(F.count("*").alias("c"))  # 4,096 a task, at most
    w = Window.partitionBy("task")
    bins = bins.select(F.col("task").alias("t"), F.col("b").alias("bb"), F.coalesce(F.sum("c").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.greatest(F.lit(1), F.floor(F.sum("c").over(w) * F.lit(SHARE))).alias("val"))
    e = e.join(F.broadcast(bins), (F.col("task") == F.col("t")) & (F.col("b") == F.col("bb")))  # bounded as above
    k = F.col("before") + F.row_number().over(Window.partitionBy("task", "b").orderBy("h", "conv_id", "turn"))
    return e.withColumn("split", F.when(k <= F.col("val"), "val").otherwise("train")).select("conv_id", "turn", "task", "ids", "loss_start", "split")


@query(f"WITH {_READY} SELECT conv_id, turn, task, split, n_ids, loss_start FROM ready")
def prepared_examples(spark, sf_dir):
    return prepared(spark, sf_dir).select("conv_id", "turn", "task", "split", F.size("ids").cast("long").alias("n_ids"), F.col("loss_start").cast("long").alias("loss_start"))


@query(f"""WITH {_READY}, c AS (SELECT split, task, count(*) AS n FROM ready GROUP BY ALL)
SELECT {len(A.VOCABULARY)}::BIGINT AS vocab_size, {BLOCK}::BIGINT AS block_size, max(n_ids) AS max_len, {A.VOCABULARY['<pad>']}::BIGINT AS pad_id, count_if(split = 'train')::BIGINT AS n_train, count_if(split = 'val')::BIGINT AS n_val,
(SELECT string_agg(split || ':' || task || ':' || n, ',' ORDER BY split, task) FROM c) AS task_counts FROM ready""")
def prepared_meta(spark, sf_dir):
    """What the sink writes beside the examples: sizes, the longest sequence, counts of each task."""
    p = once(prepared(spark, sf_dir), "prepared")
    c = p.groupBy("split", "task").agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "split", "task", "n"))), ",").alias("task_counts"))
    m = p.agg(F.lit(len(A.VOCABULARY)).cast("long").alias("vocab_size"), F.lit(BLOCK).cast("long").alias("block_size"), F.max(F.size("ids")).cast("long").alias("max_len"), F.lit(A.VOCABULARY["<pad>"]).cast("long").alias("pad_id"), F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
    return m.crossJoin(c)  # one row each


def write_prepared(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The examples, a folder a split, and the meta row beside them."""
    readers.write_parquet(prepared(spark, sf_dir), f"{path}/examples", "split")
    readers.write_json(prepared_meta(spark, sf_dir).coalesce(1), f"{path}/meta")


_KNOWN = f"array_to_string(list_filter(regexp_extract_all({{}}, '(?s).'), lambda t: contains({D.q(A.CHARACTERS)}, t)), '')"


@query(f"WITH {_READY} SELECT conv_id, turn, {_KNOWN.format('src')} AS src, {_KNOWN.format('tgt')} AS gold FROM ready")
def decoded_examples(spark, sf_dir):
    """Source and target out of the ids; characters beyond the vocabulary are gone."""
    src, gold = X.decode_example(F.col("ids"), F.col("loss_start"))
    return prepared(spark, sf_dir).select("conv_id", "turn", src.alias("src"), gold.alias("gold"))


@query(f"""WITH {_READY}, m AS (SELECT *, max(n_ids) OVER (PARTITION BY conv_id // 8) AS width FROM ready) SELECT conv_id // 8 AS batch, conv_id, turn, width, width - n_ids AS n_pad, n_ids - loss_start AS n_loss FROM m""")
def padded_batches(spark, sf_dir):
    """Batches of eight conversations, padded to the longest example; the loss covers the target and its end."""
    p = prepared(spark, sf_dir).withColumn("batch", F.floor(F.col("conv_id") / 8))
    p = p.withColumn("width", F.max(F.size("ids")).over(Window.partitionBy("batch")))
    p = p.withColumn("padded", F.concat("ids", F.array_repeat(F.lit(A.VOCABULARY["<pad>"]), F.col("width") - F.size("ids"))))
    pads = F.size(F.filter("padded", lambda x: x == A.VOCABULARY["<pad>"]))
    return p.select("batch", "conv_id", "turn", F.size("padded").cast("long").alias("width"), pads.cast("long").alias("n_pad"), (F.size("ids") - F.col("loss_start")).cast("long").alias("n_loss"))


STEPS, WARM, PEAK, LOW = 400, 40, 1e-3, 1e-4


@query(f"""SELECT s AS step, round(CASE WHEN s < {WARM} THEN {PEAK}::DOUBLE * (s + 1) / {WARM} ELSE {LOW}::DOUBLE + 0.5::DOUBLE * ({PEAK}::DOUBLE - {LOW}::DOUBLE) * (1 + cos(pi() * (s - {WARM})::DOUBLE / ({STEPS} - {WARM}))) END, 9) AS rate FROM (SELECT unnest(range(0, {STEPS})) AS s)""")
def learning_rates(spark, sf_dir):
    """Warm-up and cosine decay."""
    s = F.col("step")
    rate = F.when(s < WARM, F.lit(PEAK) * (s + 1) / WARM).otherwise(F.lit(LOW) + 0.5 * (F.lit(PEAK) - F.lit(LOW)) * (1 + F.cos(F.pi() * (s - WARM).cast("double") / (STEPS - WARM))))
    return spark.range(STEPS).withColumnRenamed("id", "step").select("step", F.round(rate, 9).alias("rate"))


# --- evaluation -----------------------------------------------------------------------------------------------
_TRI = R._SQL["trigram_logprob"]


@query(_TRI[: _TRI.rindex("SELECT item_id, round(avg(")] .rstrip() + ", ps AS (SELECT item_id, ln(" + _TRI.split("avg(ln(")[1].split(")), 6)")[0] + ") AS lp FROM b" + _TRI.split("FROM b")[-1].replace(" GROUP BY item_id", "") + "), per AS (SELECT item_id, avg(lp) AS lm, count(*) AS n FROM ps GROUP BY item_id) SELECT sum(n)::BIGINT AS n_letters, round(sum(-lm * n) / sum(n) / ln(2), 5) AS bits FROM per")
def trigram_bits(spark, sf_dir):
    """Bits a letter of the benchmark texts: the mean of the texts' losses, weighed by their letters."""
    g = R._grams(R.table(spark, sf_dir, "benchmark"), "item_id")
    per = R.trigram_scores(R.trigram_counts(spark, sf_dir), g, "item_id")
    return per.agg(F.sum("n_letters").alias("n_letters"), F.round(F.sum(-F.col("lm") * F.col("n_letters")) / F.sum("n_letters") / F.log(F.lit(2.0)), 5).alias("bits"))


_PARTS = "list_filter(list_transform(string_split(regexp_replace({}, '^<seg>', ''), '|'), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""WITH {D.lines('benchmark', 'item_id')}, w AS (SELECT item_id, pos, string_split(line, ' ') AS ws FROM lines),
p AS (SELECT item_id, pos, '<seg>' || array_to_string(ws, ' | ') AS gold, CASE WHEN (item_id + pos) % 3 = 0 THEN '<seg>' || replace(array_to_string(ws, '| |'), 'a| |', 'a') ELSE array_to_string(ws, ' |  ') END AS pred FROM w),
s AS (SELECT item_id, pos, {_PARTS.format('gold')} AS g, {_PARTS.format('pred')} AS q FROM p),
t AS (SELECT *, CASE WHEN len(g) > 4 THEN 'long' ELSE 'short' END AS task FROM s WHERE len(g) > 0)
SELECT task, count(*) AS n, count_if(g = q)::BIGINT AS n_exact, count_if(array_to_string(g, '') = array_to_string(q, ''))::BIGINT AS n_surface, printf('%d/%d (%.1f%%)', count_if(g = q)::BIGINT, count(*), 100.0::DOUBLE * count_if(g = q) / count(*)) AS shown FROM t GROUP BY task""")
def task_report(spark, sf_dir):
    """Predictions, as a decoder would write them, against the gold words of each line, by length: exact, same surface, in percent."""
    l = R.lines(R.table(spark, sf_dir, "benchmark"), "item_id").withColumn("w", F.split("line", " "))
    broken = F.concat(F.lit("<seg>"), F.replace(F.array_join("w", "| |"), F.lit("a| |"), F.lit("a")))
    pred = F.when((F.col("item_id") + F.col("pos")) % 3 == 0, broken).otherwise(F.array_join("w", " |  "))
    s = l.select(X.parts_of(F.concat(F.lit("<seg>"), F.array_join("w", " | "))).alias("g"), X.parts_of(pred).alias("q")).filter("size(g) > 0")
    t = s.groupBy(F.when(F.size("g") > 4, "long").otherwise("short").alias("task")).agg(F.count("*").alias("n"), F.count_if(F.col("g") == F.col("q")).alias("n_exact"), F.count_if(F.array_join("g", "") == F.array_join("q", "")).alias("n_surface"))
    return t.withColumn("shown", F.format_string("%d/%d (%.1f%%)", "n_exact", "n", 100.0 * F.col("n_exact") / F.col("n")))


@query(f"""WITH {R._HELD}, d AS (SELECT doc_id, bool_or(h.w IS NOT NULL) AS oov FROM words LEFT JOIN held h ON h.w = word GROUP BY doc_id)
SELECT (SELECT count(*) FROM held) AS n_held, (SELECT count(*) FROM held JOIN (SELECT pada FROM lex ANTI JOIN held ON w = pada) ab ON ab.pada = held.w) AS n_leaks, round(avg(oov::INT), 6) AS share FROM d""")
def oov_leak_check(spark, sf_dir):
    """Held words, those still in the lexicon without them (none), and the share of documents that hold one."""
    w = once(R.document_words(spark, sf_dir), "words")
    lex = once(R.lexicon(spark, sf_dir).withColumnRenamed("pada", "word"), "lexicon")
    held = once(R._held(w, lex), "held")
    ablated = lex.join(held, F.col("word") == F.col("held"), "left_anti")
    leaks = held.join(ablated, F.col("word") == F.col("held"), "left_semi").agg(F.count("*").alias("n_leaks"))
    share = R._with_held(w, held).groupBy("doc_id").agg(F.max(F.col("held").isNotNull().cast("int")).alias("oov")).agg(F.round(F.avg("oov"), 6).alias("share"))
    return held.agg(F.count("*").alias("n_held")).crossJoin(leaks).crossJoin(share)  # one row each


# --- the analyzer over the split pool --------------------------------------------------------------------------
def ranked(spark: SparkSession, texts: DataFrame, lex: DataFrame, t3: DataFrame) -> DataFrame:
    """(text, padas, n, oov, score, rank): splits of each text and the text itself, once each, by lexicon and trigram model.

    ``texts``: (text). The score is the registry's symbolic one with 0.15 of the model's mean logarithm a letter.
    """
    pool = sandhi.split(texts, "text").select(F.col("word").alias("text"), "cand", "padas")
    pool = pool.unionByName(texts.select("text", F.lit(99).cast("long").alias("cand"), F.col("text").alias("padas")))
    pool = once(pool.groupBy("text", "padas").agg(F.min("cand").alias("cand")), "pool")
    top = lex.agg(F.max("freq").alias("m"))
    words = pool.select("text", "padas", "cand", F.explode(F.split("padas", "[|]")).alias("pada")).join(lex, "pada", "left").crossJoin(F.broadcast(top))  # one row
    s = words.groupBy("text", "padas", "cand").agg(F.count("*").alias("n"), F.avg(F.col("freq").isNotNull().cast("int")).alias("cov"), (F.sum(F.log1p(F.coalesce("freq", F.lit(0)))) / (F.count("*") * F.log1p(F.first("m")))).alias("fw"), F.count_if(F.col("freq").isNull()).alias("oov"))
    lm = R.trigram_scores(t3, R.grams_of(pool.withColumn("line", F.replace("padas", F.lit("|"), F.lit(" "))), "text", "padas"), "text", "padas")
    score = F.round(4.0 * F.col("cov") + 0.5 * F.col("fw") - 0.6 * F.col("oov") + 0.15 * F.col("lm") - 0.05 * F.col("n"), 5)
    s = s.join(lm, ["text", "padas"]).withColumn("score", score)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), "cand")).cast("long")).select("text", "padas", "n", "oov", "score", "rank")


@query()
def segment_ranked(spark, sf_dir):
    """The six best segmentations of fused word pairs among all splits and the text itself."""
    texts = R.fused_pairs(spark, sf_dir).select(F.col("src").alias("text")).distinct()
    return ranked(spark, texts, once(R.lexicon(spark, sf_dir), "lexicon"), R.trigram_counts(spark, sf_dir)).filter("rank <= 6")


@query()
def split_pool_sizes(spark, sf_dir):
    """Mean, median and largest pool of splits of the fused pairs."""
    texts = R.fused_pairs(spark, sf_dir).select(F.col("src").alias("word")).distinct()
    n = sandhi.split(texts).groupBy("word").agg(F.count("*").alias("pool"))
    return n.agg(F.count("*").alias("n"), F.round(F.avg("pool"), 6).alias("mean_pool"), F.percentile("pool", F.lit(0.5)).alias("median_pool"), F.max("pool").alias("max_pool"))


@query()
def analyze_texts(spark, sf_dir):
    """The words of the best segmentation of each fused pair, with their frequency and up to two roots."""
    lex = once(R.lexicon(spark, sf_dir), "lexicon")
    texts = R.fused_pairs(spark, sf_dir).select(F.col("src").alias("text")).distinct()
    best = ranked(spark, texts, lex, R.trigram_counts(spark, sf_dir)).filter("rank = 1").select("text", F.posexplode(F.split("padas", "[|]")).alias("at", "pada"))
    known = roots(spark).groupBy("root").agg(F.slice(F.array_sort(F.collect_list(F.struct("code", "gana", "artha"))), 1, 2).alias("entries"))
    out = best.join(lex, "pada", "left").join(F.broadcast(known), F.col("pada") == F.col("root"), "left")  # a fixed table
    return out.select("text", F.col("at").cast("long").alias("at"), "pada", F.col("freq").isNotNull().alias("in_lexicon"), F.coalesce("freq", F.lit(0)).alias("freq"), F.coalesce(F.size("entries"), F.lit(0)).cast("long").alias("n_roots"), F.array_join("entries.code", ",").alias("codes"))


@query()
def tiered_segment(spark, sf_dir):
    """The cover of each fused pair that the lexicon and the trigram model prefer together: its score plus the model's logarithms of all letters."""
    covers = once(R.kbest_segment(spark, sf_dir), "covers")
    lines = covers.select("src", "cand", F.replace("padas", F.lit("|"), F.lit(" | ")).alias("line"))
    lm = R.trigram_scores(R.trigram_counts(spark, sf_dir), R.grams_of(lines, "src", "cand"), "src", "cand")
    joint = F.round(F.col("score") + F.col("lm") * F.col("n_letters"), 5)
    best = covers.join(lm, ["src", "cand"]).groupBy("src").agg(F.max_by(F.struct("padas", "tier", "cand", joint.alias("joint")), F.struct(joint, -F.col("cand"))).alias("b"))
    return best.select("src", "b.padas", "b.tier", "b.cand", "b.joint")
