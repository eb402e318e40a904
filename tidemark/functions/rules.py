"""Rule tables of the text functions, as data that callers may replace."""

from __future__ import annotations

import functools
import zipfile
from pathlib import Path

# ---- Fixed values: results depend on each of them and on their order. ----

DOMAIN_STOPWORDS = (
    "paper approach method methods model models system systems framework frameworks study studies "
    "analysis results using based toward towards via new novel efficient robust improved computer "
    "science research problem problems application applications task tasks dataset datasets "
    "algorithm algorithms learning arxiv org ieee access acm springer journal conference proceedings "
    "thing things review transaction symposium chapter meeting survey international transactions "
    "aacl icml nips iccv cvpr aaai ijcai kdd sigmod scale use does as well can may should do is are "
    "be have has been given made reason note why how what when where which vol pp pages page edition "
    "press publishing publisher data information value set type part way state"
).split()

VENUES = "aacl icml nips iccv cvpr aaai ijcai kdd sigmod acl emnlp naacl coling infocom sigcomm osdi sosp".split()

#: (pattern, replacement), applied one after the other, without regard to case.
PHRASE_RULES = [
    (r"\bquery optimization\b", "query optimization"),
    (r"\bquery processing\b", "query optimization"),
    (r"\bSQL query\b", "query optimization"),
    (r"\bsql optimization\b", "query optimization"),
    (r"\bqueries\b", "query optimization"),
    (r"\bquery\b", "query optimization"),
    (r"\bremote sensing\b", "remote sensing"),
    (r"\bremote image\b", "remote sensing"),
    (r"\bremote imagery\b", "remote sensing"),
    (r"\bsatellite remote sensing\b", "remote sensing"),
    (r"\bsatellite imaging\b", "remote sensing"),
    (r"\blarge language model\b", "llm"),
    (r"\blarge language\b", "llm"),
    (r"\bllms?\b", "llm"),
    (r"\bcloud computing international\b", "cloud computing"),
    (r"\bdistributed international\b", "distributed"),
    (r"\bdistributed systems\b", "distributed systems"),
    (r"\bdenoising diffusion probabilistic\b", "denoising diffusion"),
    (r"\btext to image diffusion\b", "text-to-image diffusion"),
    (r"\btext-to-image diffusion\b", "text-to-image diffusion"),
    (r"\btext to image\b", "diffusion"),
    (r"\btext-to-image\b", "diffusion"),
    (r"\bautoencoders?\s+scalable\b", "autoencoders"),
    (r"\bvariational autoencoders?\b", "autoencoders"),
    (r"\bautoencoders?\b", "autoencoders"),
    (r"\bretrievel-augmented generation\b", "retrieval-augmented generation"),
    (r"\bretrieval-augmented generation\b", "retrieval-augmented generation"),
    (r"\bretrieval.?augmented\b", "retrieval-augmented generation"),
    (r"\bfairness accountability transparency\b", "fairness accountability"),
    (r"\bfairness accountability\b", "fairness accountability"),
    (r"\bsupport vector machines?\b", "support vector machine"),
    (r"\bvector machines?\b", "support vector machine"),
    (r"\bsoftware engineering\b", "software engineering"),
    (r"\bsoftware\b", "software engineering"),
    (r"\bexplainability\b", "interpretability"),
    (r"\bfairness\b", "interpretability"),
    (r"\btransparency\b", "interpretability"),
    (r"\bexplainable\b", "interpretability"),
    (r"\bfair machine learning\b", "interpretability"),
    (r"\bfairness accountability\b", "interpretability"),
    (r"\breinforcement learning\b", "reinforcement learning"),
    (r"\bq-learning\b", "reinforcement learning"),
    (r"\bpolicy gradient\b", "reinforcement learning"),
    (r"\bpolicy learning\b", "reinforcement learning"),
    (r"\bdeep reinforcement learning\b", "reinforcement learning"),
    (r"\bdrl\b", "reinforcement learning"),
    (r"\b(?:^|\s)rl(?:\s|$)\b", "reinforcement learning"),
    (r"\bmarkov decision process\b", "reinforcement learning"),
    (r"\bmdp\b", "reinforcement learning"),
    (r"\bconvolutional neural network\b", "convolutional neural network"),
    (r"\bcnn\b", "convolutional neural network"),
    (r"\brecurrent neural network\b", "recurrent neural network"),
    (r"\brnn\b", "recurrent neural network"),
    (r"\blong short-term memory\b", "lstm"),
    (r"\blstm\b", "lstm"),
    (r"\bgru\b", "gated recurrent unit"),
    (r"\bgated recurrent unit\b", "gated recurrent unit"),
    (r"\bself-attention\b", "attention mechanism"),
    (r"\bself attention\b", "attention mechanism"),
    (r"\bmulti-head attention\b", "attention mechanism"),
    (r"\bmulti head attention\b", "attention mechanism"),
    (r"\btransformer\b", "attention mechanism"),
    (r"\battention mechanism\b", "attention mechanism"),
    (r"\battention\b", "attention mechanism"),
    (r"\bbert\b", "attention mechanism"),
    (r"\bgpt\b", "attention mechanism"),
    (r"\bvision transformer\b", "attention mechanism"),
    (r"\bvit\b", "attention mechanism"),
    (r"\breasoning language\b", "reasoning"),
    (r"\breason language\b", "reasoning"),
    (r"\bllm reasoning\b", "llm reasoning"),
    (r"\bgenerative adversarial networks?\b", "generative adversarial network"),
    (r"\bgenerative models?\b", "generative model"),
    (r"\bneural networks?\b", "neural network"),
    (r"\bensemble methods?\b", "ensemble method"),
]

SINGULARS = "model network algorithm method system dataset feature layer neuron filter kernel function classifier regressor".split()
DROPPED_SUFFIXES = "scalable based probabilistic enhanced accelerated efficient large small improved".split()
NOISE = "arxiv org doi http aacl acl".split()

#: (topic, substrings): the first family with a substring in the text; else DEFAULT_TOPIC.
FALLBACKS = [
    ("Natural Language Processing", "sentiment|text|language|word|parsing|token|embed|linguistic|annotation|corpus|nltk|rouge|bleu|metric|summary|abstract|semantic|syntactic|dialog".split("|")),
    ("Computer Vision", "image|visual|video|scene|object|photo|pixel|edge|color|picture|shape|feature detection".split("|")),
    ("Software Engineering", "test|verification|correctness|validation|proof|formal|quality|review|procedure|methodology".split("|")),
    ("Bioinformatics and Computational Biology", "medical|health|clinical|hospital|patient|disease|diagnosis|treatment|drug|biomedical|genomic|molecular|protein|cell".split("|")),
    ("Information Retrieval", "search|query|retrieval|ranking|document|index|database|sql|table".split("|")),
    ("Computer Networks", "network|distributed|parallel|concurrent|protocol|communication|routing|internet|wireless".split("|")),
    ("Security and Privacy", "security|privacy|encryption|authentication|attack|malware|intrusion|threat".split("|")),
    ("Theory and Algorithms", "algorithm|complexity|approximation|graph|combinatorial|computational".split("|")),
]
DEFAULT_TOPIC = "Machine Learning"

#: child: direct parents.
PARENTS = {"Large Language Models": ["Natural Language Processing", "Deep Learning", "Machine Learning"], "Generative Models": ["Deep Learning", "Machine Learning"]} | dict.fromkeys(
    (
        "Natural Language Processing", "Reinforcement Learning", "Deep Learning", "Computer Vision", "Graph Machine Learning", "Optimization", "Statistical Learning",
        "Kernel Methods / SVM", "Data Mining", "Information Retrieval", "Recommender Systems", "Robotics and Control", "Explainable / Fair / Causal AI",
    ),
    ["Machine Learning"],
)

#: Keywords that point to a topic which a paper lacks.
INDICATORS = {
    "Data Mining": ["association"],
    "Computer Networks": ["iot", "edge computing", "wireless sensor"],
    "Computer Vision": ["cnn", "tracking", "yolo", "bounding box", "real-time object"],
}

# ---- End of the fixed values. ----


def term_pattern(term: str) -> str:
    """A term as a rule: whole words, any blank or hyphen between them, an optional plural s."""
    return r"\b" + r"[- ]?".join(term.split()) + r"(s)?\b"


#: The default taxonomy: terms by topic, made into patterns by term_pattern(). A full taxonomy is a
#: parameter of the tagger (see taxonomy_from_json).
TOPIC_TERMS = {
    "Large Language Models": "large language model;llm;foundation model;language model;prompting;instruction tuning",
    "Natural Language Processing": "natural language processing;machine translation;text classification;question answering;summarization;named entity",
    "Reinforcement Learning": "reinforcement learning;policy gradient;multi armed bandit;actor critic;markov decision process",
    "Machine Learning": "machine learning;supervised learning;classification;regression;transfer learning;meta learning",
    "Deep Learning": "deep learning;neural network;convolutional network;recurrent network;transformer;autoencoder",
    "Computer Vision": "computer vision;object detection;image segmentation;image classification;face recognition;optical flow",
    "Graph Machine Learning": "graph neural network;graph embedding;node classification;link prediction;knowledge graph",
    "Generative Models": "generative model;diffusion model;generative adversarial network;normalizing flow;image synthesis",
    "Optimization": "optimization;gradient descent;convex programming;evolutionary algorithm;integer programming",
    "Statistical Learning": "bayesian inference;gaussian process;graphical model;monte carlo;variational inference",
    "Kernel Methods / SVM": "support vector machine;kernel method;kernel trick;svm",
    "Data Mining": "data mining;frequent pattern;clustering;anomaly detection;association rule",
    "Information Retrieval": "information retrieval;search engine;learning to rank;query expansion;document ranking",
    "Recommender Systems": "recommender system;collaborative filtering;recommendation;matrix factorization",
    "Robotics and Control": "robot;motion planning;robotics;autonomous vehicle;optimal control",
    "Databases and Data Management": "database;query optimization;data warehouse;transaction processing;data integration",
    "Distributed Systems and Cloud": "distributed system;cloud computing;consensus protocol;fault tolerance;mapreduce",
    "Computer Networks": "computer network;wireless network;routing protocol;congestion control;internet of things",
    "Security and Privacy": "cryptography;differential privacy;malware;intrusion detection;authentication",
    "Software Engineering": "software engineering;software testing;program repair;code review;static analysis",
    "Programming Languages": "programming language;type system;compiler;program synthesis;garbage collection",
    "Theory and Algorithms": "approximation algorithm;computational complexity;data structure;randomized algorithm;graph theory",
    "Human-Computer Interaction": "human computer interaction;user interface;user study;usability;virtual reality",
    "Explainable / Fair / Causal AI": "explainable;interpretability;fairness;causal inference;counterfactual",
    "Bioinformatics and Computational Biology": "bioinformatics;gene expression;protein structure;drug discovery;genomics",
}


def default_taxonomy() -> dict[str, list[str]]:
    return {topic: [term_pattern(t) for t in terms.split(";")] for topic, terms in TOPIC_TERMS.items()}


def taxonomy_from_json(text: str) -> dict[str, list[str]]:
    """A taxonomy of the user: a JSON object of pattern lists by topic."""
    import json

    found = json.loads(text)
    if not isinstance(found, dict) or not all(isinstance(v, list) and all(isinstance(p, str) for p in v) for v in found.values()):
        raise ValueError("a taxonomy is an object of lists of patterns")
    return found


def closure(parents: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(topic, ancestor) over any number of steps."""
    out = set()
    for topic in parents:
        todo = list(parents[topic])
        while todo:
            p = todo.pop()
            if (topic, p) not in out:
                out.add((topic, p))
                todo += parents.get(p, [])
    return sorted(out)


@functools.cache
def stopwords() -> tuple[str, ...]:
    """Spark's English list, read from its own library, and the domain's terms."""
    import pyspark

    for jar in sorted((Path(pyspark.__file__).parent / "jars").glob("spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as z:
            english = z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split()
            return tuple(sorted({*english, *DOMAIN_STOPWORDS}))
    return tuple(sorted(set(DOMAIN_STOPWORDS)))
