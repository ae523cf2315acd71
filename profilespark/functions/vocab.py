"""Fixed values. Results depend on these being exactly these words and numbers."""

# Relation spellings and the class each belongs to.
EXACT_RELATIONS = ["EXACT", "=", "EQ", "EQUAL", "EQUALS"]
GT_RELATIONS = [">", ">=", "GT", "GE", "GTE"]
LT_RELATIONS = ["<", "<=", "LT", "LE", "LTE"]
BOUNDED_CLASSES = ["GT_BOUND", "LT_BOUND", "BOUNDED_DIRECTION_UNKNOWN"]

# Concentration units and their size in mol/l.
UNIT_TO_MOLAR = {"M": 1.0, "MM": 1e-3, "UM": 1e-6, "NM": 1e-9, "PM": 1e-12}
UNIT_ALIASES = {"MOLAR": "M", "MOL/L": "M", "MMOLAR": "MM", "UMOLAR": "UM", "NMOLAR": "NM", "PMOLAR": "PM"}

# Endpoint ranks; 1 is preferred.
ENDPOINT_PRIORITY = {
    "BINDING_KI": 1,
    "BINDING_KD": 2,
    "INHIBITION_IC50": 3,
    "ACTIVATION_EC50": 4,
    "FUNCTIONAL_AC50": 4,
    "OTHER_QUANTITATIVE_POTENCY": 5,
}

# Words that count as "no value" when the first usable value of a group is taken.
BLANK_WORDS = ["NAN", "NONE", "NA", "N/A", "UNKNOWN", "UNRESOLVED"]
TRUE_WORDS = ["1", "true", "yes", "y"]

# NCBI taxon ids that count as mammals, and the human one.
HUMAN_TAXON = 9606
MAMMAL_TAXA = [9534, 9544, 9598, 9606, 9615, 9685, 9796, 9823, 9913, 9925, 9940, 9986, 10036, 10090, 10116, 10141]

# Exact species names that are understood, with their taxon.
TAXON_BY_NAME = {
    "human": 9606, "homo sapiens": 9606, "man": 9606, "mouse": 10090, "mus musculus": 10090, "rat": 10116, "rattus norvegicus": 10116,
    "pig": 9823, "swine": 9823, "sus scrofa": 9823, "dog": 9615, "canis lupus familiaris": 9615, "cat": 9685, "felis catus": 9685,
    "rabbit": 9986, "oryctolagus cuniculus": 9986, "guinea pig": 10141, "cavia porcellus": 10141, "cow": 9913, "cattle": 9913, "bos taurus": 9913,
    "sheep": 9940, "ovis aries": 9940, "goat": 9925, "capra hircus": 9925, "horse": 9796, "equus caballus": 9796, "rhesus": 9544,
    "rhesus macaque": 9544, "macaca mulatta": 9544, "chimpanzee": 9598, "pan troglodytes": 9598, "electric eel": 8005,
    "electrophorus electricus": 8005, "torpedo californica": 7787, "chicken": 9031, "gallus gallus": 9031, "zebrafish": 7955,
    "danio rerio": 7955, "xenopus laevis": 8355,
}

# Words looked for anywhere in a species name, mammal words first.
MAMMAL_TOKENS = [
    "human", "homo sapiens", "mouse", "mus musculus", "rat", "rattus", "pig", "swine", "sus scrofa", "dog", "canis",
    "cat", "felis", "rabbit", "oryctolagus", "guinea pig", "cavia", "cow", "cattle", "bos taurus", "sheep", "ovis",
    "goat", "capra", "horse", "equus", "macaque", "macaca", "chimpanzee", "pan troglodytes", "hamster",
]
OTHER_TOKENS = [
    "eel", "electrophorus", "torpedo", "ray", "chicken", "gallus", "zebrafish", "danio", "xenopus", "frog", "fish",
    "drosophila", "insect", "yeast", "bacteria", "bacterial", "e. coli", "escherichia",
]

# Grain words accepted as an exact single protein, and generic labels that are never split.
EXACT_GRAINS = ["EXACT_SINGLE_PROTEIN", "EXACT PROTEIN", "SINGLE PROTEIN"]
GENERIC_RECEPTORS = ["nmda receptor", "n-methyl-d-aspartate receptor", "gabaa receptor", "gaba-a receptor"]

# Outlier levels and the pair gate.
ALPHAS = (0.001, 0.0001)
GATE_FEATURES = 20
GATE_TARGETS = 2
