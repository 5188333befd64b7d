"""Column builders for phrases as labels of topics: words, rewriting, what makes a poor label, how specific one is, its family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that neither terms nor phrases are made of.
FUNCTION_WORDS = "a an and are as at be been being by can for from has have in into is it its new of on or our paper papers study system systems that the their this to toward towards using via we with without".split()
FILLER = "which propose proposed show shows shown used use such these different performance datasets dataset does not only also one most state-of-the-art".split()
# Words that are no terms by themselves, and those left out of phrases only.
TERM_STOPWORDS = [
    *FUNCTION_WORDS,
    *"algorithm algorithms analysis application applications approach approaches based data deep framework learning method methods model modeling models network networks neural problem problems results task tasks training".split(),
    *FILLER,
    *"http https www com org github available availability repository repositories supplementary appendix extensive experiments experiment experimental".split(),
]
PHRASE_STOPWORDS = [
    *FUNCTION_WORDS,
    *FILLER,
    *"available availability extensive experiments experiment experimental results result http https www com org github repository repositories supplementary appendix xmlns mml mathml".split(),
]
# Phrases that words left out have cut short, and what they stand for.
REWRITES = {
    "large language llms": "large language models",
    "large language llm": "large language models",
    "language llms": "large language models",
    "language llm": "large language models",
    "multimodal large language": "multimodal large language models",
    "reasoning large language": "large language model reasoning",
    "large language reasoning": "large language model reasoning",
    "graph gnns": "graph neural networks",
    "graph convolutional gcns": "graph convolutional networks",
    "graph convolutional gcn": "graph convolutional networks",
    "convolutional cnns": "convolutional neural networks",
    "convolutional cnn": "convolutional neural networks",
    "reinforcement drl": "deep reinforcement learning",
    "multi-agent reinforcement marl": "multi-agent reinforcement learning",
    "reinforcement human feedback": "reinforcement learning from human feedback",
    "human feedback rlhf": "reinforcement learning from human feedback",
    "machine translation nmt": "neural machine translation",
    "translation nmt": "neural machine translation",
    "speech recognition asr": "automatic speech recognition",
}
# Phrases that make a label good whatever words they hold, and what spoils even these.
STRONG = ["large language model", "language model", "graph neural network", "convolutional neural network", "reinforcement learning", "machine learning", "neural machine translation", "natural language processing", "automatic speech recognition", "knowledge graph", "message passing"]
SPOILED = ["github", "https", "xmlns", "mathml"]
# Labels that say too little, and parts of boilerplate.
BANNED = [
    "computer science", "artificial intelligence", "machine learning", "deep learning", "mathematics", "statistics", "engineering", "biology", "physics", "philosophy", "linguistics", "data science",
    "pattern recognition (psychology)", "image (mathematics)", "feature (linguistics)", "object (grammar)", "task (project management)", "set (abstract data type)", "process (computing)", "representation (politics)",
    "field (mathematics)", "domain (mathematical analysis)", "closed captioning", "storytelling", "transition (genetics)", "complement (music)", "point (geometry)", "taxonomy (biology)", "mathematical analysis",
    "programming language", "operating system", "advanced neural network applications", "advanced machine learning", "state art", "state-of-the-art", "recent years", "rather than", "simple yet effective",
]
BANNED_PARTS = ["github", "http", "available", "extensive experiment", "experimental result", "xmlns", "mathml", "mml math"]
ARXIV_CATEGORY = r"^(cs|stat|eess|math|physics|q-bio|q-fin|econ)\.[a-z]{2}$"
# Points of whole phrases that name a topic.
SPECIFIC = {
    "object detection": 45, "image classification": 40, "computer vision": 30, "semantic segmentation": 40, "convolutional neural networks": 45, "visual recognition": 30,
    "random forest": 45, "anomaly detection": 45, "feature selection": 40, "support vector machine": 40, "decision trees": 30, "decision tree": 30, "concept drift": 35, "logistic regression": 25, "gradient boosting": 30, "time series": 25,
    "machine translation": 45, "neural machine translation": 50, "multilingual machine translation": 50, "low-resource machine translation": 45, "low-resource languages": 35, "natural language processing": 35, "automatic speech recognition": 35, "named entity recognition": 30,
    "large language models": 50, "large language model reasoning": 55, "mathematical reasoning": 45, "question answering": 40, "multi-hop question answering": 40, "chain-of-thought reasoning": 45, "reasoning capabilities": 30, "complex reasoning": 35,
    "graph neural networks": 55, "graph convolutional networks": 50, "node classification": 45, "link prediction": 45, "message passing": 35, "graph representation learning": 45, "knowledge graph completion": 40, "graph contrastive learning": 35,
    "reinforcement learning": 50, "deep reinforcement learning": 50, "multi-agent reinforcement learning": 55, "offline reinforcement learning": 45, "inverse reinforcement learning": 40, "policy optimization": 40, "policy gradient": 35, "sample efficiency": 35, "reward function": 35, "reward functions": 35, "value function": 30,
    "evolutionary algorithms": 45, "evolutionary algorithm": 40, "genetic algorithm": 45, "genetic programming": 35, "particle swarm optimization": 45, "multi-objective optimization": 40, "combinatorial optimization": 40, "traveling salesman problem": 35, "swarm optimization": 35, "local search": 30,
}
# Points of parents and fragments of topics.
VAGUE = {
    "machine learning": -120, "machine learning models": -120, "machine learning model": -120, "machine learning methods": -120, "machine learning algorithms": -120, "machine learning techniques": -120, "machine learning and data classification": -120,
    "learning algorithms": -100, "learning models": -100, "neural networks": -120, "deep neural networks": -100, "neural network": -100, "neural networks cnns": -140, "networks cnns": -140,
    "language models": -100, "language model": -80, "large language": -130, "models llms": -150, "language models llms": -150, "graph": -150, "graph neural": -150, "networks gnns": -150, "neural networks gnns": -150,
    "convolutional neural": -150, "deep neural": -140, "deep reinforcement": -130, "multi-agent reinforcement": -130, "natural language": -100, "optimization problems": -100, "optimization problem": -100, "optimization algorithms": -100, "mathematical optimization": -80,
    "metaheuristic optimization algorithms research": -140, "evolutionary algorithms and applications": -100, "natural language processing techniques": -80, "domain adaptation and few-shot learning": -80, "theoretical computer science": -100, "representation learning": -70, "reasoning tasks": -70,
}
# Those of VAGUE that may be a label where nothing better is there.
TOLERATED = ["neural network", "language models", "language model"]
# Singulars that go where their plural is a label.
SINGULARS = ["graph convolutional network", "graph neural network", "convolutional neural network"]
# Families of topics by what their labels have in them, in the order they are tried, and labels that are in one by name.
FAMILIES = {
    "large_language_models": ["large language", "language model", "llm"],
    "machine_translation": ["machine translation", "translation nmt"],
    "natural_language_processing": ["natural language processing"],
    "graph_learning": ["graph neural", "graph convolutional", "message passing", "node classification", "link prediction", "graph representation", "knowledge graph"],
    "reinforcement_learning": ["reinforcement learning"],
    "computer_vision": ["object detection", "image classification", "computer vision", "semantic segmentation", "convolutional neural", "visual recognition"],
    "classical_ml": ["random forest", "anomaly detection", "feature selection", "support vector", "decision tree", "concept drift", "logistic regression", "gradient boosting"],
    "evolutionary_optimization": ["genetic algorithm", "evolutionary algorithm", "particle swarm", "multi-objective optimization", "combinatorial optimization", "traveling salesman"],
}
BY_NAME = {"reinforcement_learning": ["policy optimization", "sample efficiency", "reward function", "reward functions", "value function", "policy gradient"]}


def _lookup(c: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def _holds(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def term(c: Column) -> Column:
    """Lower case, runs of white space as one space; null as empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " ")), F.lit(""))


def rewritten(c: Column) -> Column:
    """A term as the phrase that it stands for."""
    return F.coalesce(_lookup(term(c), REWRITES), term(c))


def words(c: Column, without: list[str]) -> Column:
    """Words of three and more letters, digits and hyphens that start with a letter, but for those left out; null as none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z][a-z0-9\-]{2,})"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(without))


def is_poor(c: Column) -> Column:
    """Whether a term is no label: empty, short, a stop word, a category's code, too broad, or boilerplate."""
    t = term(c)
    poor = t.isin(TERM_STOPWORDS) | t.isin(BANNED) | t.rlike(ARXIV_CATEGORY) | (F.length(t) < 4) | _holds(t, BANNED_PARTS)
    return F.when(t == "", True).when(_holds(t, STRONG), _holds(t, SPOILED)).otherwise(poor)


def specificity(c: Column) -> Column:
    """Eight points for each word; more for a topic's name, fewer for a part or parent of one."""
    t = term(c)
    return F.size(F.filter(F.split(t, " "), lambda w: w != "")) * 8 + F.coalesce(_lookup(t, SPECIFIC), F.lit(0)) + F.coalesce(_lookup(t, VAGUE), F.lit(0))


def family(c: Column) -> Column:
    """The family of topics that a label belongs to; else its first word."""
    t = term(c)
    out = F.when(t == "", "unknown")
    for name, parts in FAMILIES.items():
        out = out.when(_holds(t, parts) | t.isin(BY_NAME.get(name, [])), name)
    return out.otherwise(F.split(t, " ")[0])


def is_redundant(t: Column, taken: Column) -> Column:
    """Whether a label is a part of a topic's name by itself, or says what one of those taken says: the same, up to two words within it, or its singular."""
    part = t.isin([x for x in VAGUE if x not in TOLERATED])
    short = F.size(F.split(t, " ")) <= 2
    return part | F.exists(taken, lambda x: (x == t) | (short & F.contains(x, t)) | (t.isin(SINGULARS) & F.contains(x, F.concat(t, F.lit("s")))))
