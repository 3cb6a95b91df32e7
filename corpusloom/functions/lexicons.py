"""Word lists and lookup tables, as data."""

# Spanish stop words of the word-frequency report.
STOP_WORDS = (
    "el la de que y a en un es se no te lo le da su por son con para al del las los una como pero sus fue ser ha mas ya o si me mi muy "
    "esto esta este tan todo todos hace hacer tiene tener donde cuando quien porque cual sobre tras ante bajo cabe contra desde durante "
    "hacia hasta mediante segun sin excepto salvo incluso tambien ademas"
).split()

# Regional terms whose occurrences are counted.
REGIONAL_TERMS = (
    "cuba", "cubano", "cubana", "habana", "habanero", "camagüey", "santiago", "guantánamo", "matanzas", "pinar", "río", "villa", "isla",
    "revolución", "fidel", "che", "martí", "maceo", "céspedes", "mambí", "guajiro", "bohío", "conuco", "yuca", "malanga", "boniato",
    "plátano", "ron", "salsa", "rumba", "conga", "son", "trova", "nueva", "guaracha", "cienfuegos", "holguín", "bayamo", "las tunas",
    "villa clara", "varadero", "artemisa", "mayabeque", "baracoa", "trinidad", "granma", "vinales", "soroa", "cayo coco",
    "cayo largo", "malecon", "malecón", "oriente", "occidente", "sancti spíritus", "la habana", "guanabo", "habanos", "tabaco", "cohiba",
    "montecristo", "mojito", "moros y cristianos", "ropa vieja", "ajiaco", "tostones", "frita", "croqueta", "papas rellenas", "mariquitas",
    "casabe", "empanada gallega", "café cubano", "colada", "cafecito", "cafetera", "guarapo", "caña", "guantanamera", "paladar",
    "benny moré", "celia cruz", "omara portuondo", "compay segundo", "silvio rodríguez", "pablo milanés", "camilo cienfuegos",
    "vilma espín", "ujc", "pcc", "revolucionario", "bloqueo", "martiniano", "qué volá", "que vola", "que bola", "que bolero", "qué bola",
    "qué bolero", "acere", "asere", "consorte", "socio", "ecobio", "fajao", "fajarse", "chama", "ambia", "tremendo", "pincha",
    "pinchando", "comemierda", "descarao", "baro", "guagua", "yuma", "ño", "caballero", "oye", "jama", "singe", "fiao", "mulato", "mango",
    "fiñe", "sal pa’ fuera", "talla", "monina", "resuelve", "arrancao", "arrancáo", "planchao", "cubalibre", "cuba libre", "cantineros",
    "cachita", "guajira", "mamoncillo", "chicharrón", "mojo criollo", "frijoles negros", "tamal en cazuela", "boniatillo",
    "dulce de leche cortada",
)
FORMAL_TERMS = ("establecer", "mediante", "considerar", "determinar", "constituir", "disponer", "facultar", "reglamentar", "promulgar", "cuantificar", "articular", "análogo", "subsiguiente")
INFORMAL_TERMS = ("chévere", "bacán", "asere", "pana", "jefe", "qué tal", "qué volá", "qué bola", "acere", "oye", "mi hermano", "tremendo", "chama")

# Names of languages; others show their code in capitals.
LANGUAGE_NAMES = {"es": "Spanish", "en": "English", "ca": "Catalan", "pt": "Portuguese", "fr": "French"}

# Descriptions of source directories.
DOMAIN_DESCRIPTIONS = {
    "biblioteca digital de la dramaturgia de la gran cuba": "Cuban theatrical works and dramatic literature",
    "diccionario de la literatura cubana": "Cuban literary encyclopedia and references",
    "enciclopedia digital del audiovisual cubano": "Cuban audiovisual and media content",
    "descargas": "Downloaded content and miscellaneous documents",
    "discursos_fidel_cleaned": "Political speeches and historical documents",
    "ecured": "Cuban Wikipedia and encyclopedic content",
    "gaceta": "Official government publications and legal documents",
    "granma": "News articles and journalistic content",
    "jr": "Youth and revolutionary content",
    "letras_de_canciones": "Song lyrics and musical content",
    "literature": "General literary works and texts",
    "programas escolares": "Educational curricula and academic materials",
}
DEFAULT_DESCRIPTION = "Specialized Cuban content domain"

# Peak floating-point operations a second by device and precision, from data sheets.
DEVICE_FLOPS = {
    "h100-sxm": {"64-true": 67e12, "32-true": 67e12, "16-true": 989.5e12, "16-mixed": 989.5e12, "bf16-true": 989.5e12, "bf16-mixed": 989.5e12, "8-true": 1979e12, "8-mixed": 1979e12},
    "h100-pcie": {"64-true": 51e12, "32-true": 51e12, "16-true": 756.5e12, "16-mixed": 756.5e12, "bf16-true": 756.5e12, "bf16-mixed": 756.5e12, "8-true": 1513e12, "8-mixed": 1513e12},
    "a100": {"64-true": 19.5e12, "32-true": 19.5e12, "16-true": 312e12, "16-mixed": 312e12, "bf16-true": 312e12, "bf16-mixed": 312e12},
    "a10g": {"32-true": 31.2e12, "16-true": 125e12, "16-mixed": 125e12, "bf16-true": 125e12, "bf16-mixed": 125e12},
    "v100-sxm": {"64-true": 7.8e12, "32-true": 15.7e12, "16-true": 125e12, "16-mixed": 125e12},
    "v100-pcie": {"64-true": 7e12, "32-true": 14e12, "16-true": 112e12, "16-mixed": 112e12},
    "v100s-pcie": {"64-true": 8.2e12, "32-true": 16.4e12, "16-true": 130e12, "16-mixed": 130e12},
    "t4": {"32-true": 8.1e12, "16-true": 65e12, "16-mixed": 65e12, "8-true": 130e12, "int4": 260e12},
    "quadro rtx 5000": {"32-true": 11.2e12, "16-true": 89.2e12, "16-mixed": 89.2e12},
}
# A device's name holds the first fragments and one of the second; the first match counts.
DEVICE_ROUTES = (
    ("h100", ("hbm3",), "h100-sxm"),
    ("h100", ("pcie", "hbm2e"), "h100-pcie"),
    ("a100", ("",), "a100"),
    ("a10g", ("",), "a10g"),
    ("v100-sxm", ("",), "v100-sxm"),
    ("v100-pcie", ("",), "v100-pcie"),
    ("t4", ("",), "t4"),
    ("quadro rtx 5000", ("",), "quadro rtx 5000"),
)

# Peak operations a second of TPU generations, alike for all precisions.
TPU_FLOPS = {"v2": 45e12, "v3": 123e12, "v4": 275e12}

# Fragments of model names and the layer classes they lead to; the first one found counts.
LAYER_CLASSES = (
    ("gpt2", "GPT2Block"),
    ("llama", "LlamaDecoderLayer"),
    ("t5", "T5Block"),
    ("bert", "BertLayer"),
    ("roberta", "RobertaLayer"),
    ("opt", "OPTDecoderLayer"),
    ("bloom", "BloomBlock"),
    ("falcon", "FalconDecoderLayer"),
    ("mistral", "MistralDecoderLayer"),
)
