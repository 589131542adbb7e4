"""Word lists. All lists of this module are fixed values that results depend on."""

from __future__ import annotations

# Words that a title comparison skips.
TITLE_STOP_WORDS = ["the", "a", "an", "of", "on", "in", "for", "with", "by", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "out", "over", "under", "again", "further", "then", "once", "and", "or", "study", "research", "analysis", "approach", "paper"]

# Suffixes that a stem loses, the first that fits.
STEM_SUFFIXES = ["ing", "tion", "ness", "ment", "able", "ed", "es", "s"]

# Academic synonyms by the word that calls for them.
SYNONYMS = {
    "enable": ["allow", "permit", "facilitate", "enable"],
    "allow": ["enable", "permit", "facilitate", "allow"],
    "reduce": ["decrease", "lower", "diminish", "curtail", "reduce"],
    "decrease": ["reduce", "lower", "diminish", "decrease"],
    "promote": ["increase", "elevate", "enhance", "stimulate", "promote"],
    "increase": ["promote", "elevate", "enhance", "stimulate", "increase"],
    "mortality": ["death", "mortality", "deaths", "fatalities"],
    "death": ["mortality", "death", "deaths"],
    "overall": ["all-cause", "total", "overall"],
    "all-cause": ["overall", "total", "all-cause"],
    "diabetic": ["diabetic", "diabetes", "diabet"],
    "diabetes": ["diabetic", "diabetes", "diabet"],
    "diabet": ["diabetic", "diabetes", "diabet"],
    "patient": ["patient", "patients"],
    "patients": ["patient", "patients"],
}

# Words of rising and of falling, tested as substrings.
RISING = ["increase", "increases", "increased", "increasing", "promote", "promotes", "promoted", "elevate", "elevates", "elevated", "accelerate", "accelerates", "accelerated", "提升", "增加", "促进", "加速"]
FALLING = ["inhibit", "inhibits", "inhibited", "decrease", "decreases", "decreased", "reduce", "reduces", "reduced", "prevent", "prevents", "slow down", "slows down", "slowed down", "抑制", "降低", "减少", "阻碍"]

# Negation markers, English ones as words and Chinese ones as substrings.
NEGATIONS_EN = ["not", "no", "never", "cannot", "can't", "fail", "failed", "fails", "failing", "without", "neither", "nor", "lack", "lacks", "lacking", "lacked"]
NEGATIONS_ZH = ["未", "不", "没有", "未曾", "无法", "未能", "毫无", "并未"]

# Words between clauses.
CLAUSE_WORDS_EN = ["although", "however", "but", "while", "whereas", "despite", "even though", "in contrast"]
CLAUSE_WORDS_ZH = ["虽然", "但是", "然而", "尽管", "但"]

# Concepts with their Chinese and English names, tested as substrings.
CONCEPTS = [
    ["人工智能", "ai", "智能", "artificial intelligence", "machine learning", "deep learning"],
    ["劳动力", "就业", "失业", "岗位", "人才", "招聘", "labor", "labour", "employment", "unemployment", "job", "jobs", "worker", "workers", "workforce", "hiring"],
    ["匹配", "结构", "偏向", "match", "matching", "structure", "structural", "skill", "skills", "mismatch", "bias", "biased"],
    ["技术", "自动化", "创新", "technology", "technologies", "tech", "automation", "automate", "automated", "innovation"],
    ["生产率", "效率", "经济", "增长", "productivity", "efficiency", "economic", "growth", "output"],
    ["金融", "数字金融", "数字经济", "finance", "financial", "digital finance", "digital economy"],
    ["空间", "流动", "迁移", "偏好", "spatial", "space", "mobility", "migration", "migrate", "preference"],
]

# Core journals in the order in which they are looked for.
CORE_JOURNALS = ["管理世界", "经济研究", "金融研究", "软件学报", "计算机学报", "中国社会科学", "法学研究", "世界经济", "会计研究", "中国工业经济", "数理统计与管理", "情报学报", "中国管理科学", "中国人力资源开发", "城市发展研究", "数量经济技术经济研究", "地理学报", "经济学(季刊)", "经济学季刊", "经济理论与经济管理", "城市规划", "中国软科学", "学术界", "统计研究", "思想战线"]

# Marks of retraction in titles, by where the title comes from.
RETRACTED_TITLE = {
    "openalex": ["retracted"],
    "crossref_doi": ["retracted", "retraction"],
    "crossref_title": ["retracted", "retraction", "withdrawn"],
    "merged": ["retracted", "retraction", "withdrawn", "撤稿"],
}

# Retractions known without a table.
KNOWN_RETRACTIONS = [
    ("10.1126/science.1112286", "Patient-Specific Embryonic Stem Cells Derived from Human SCNT Blastocysts", "Science", "2006-01-12", "Data Fabrication — non-existent patient-specific cell lines"),
    ("10.1016/S0140-6736(97)11096-0", "Ileal-lymphoid-nodular hyperplasia, non-specific colitis, and pervasive developmental disorder in children", "The Lancet", "2010-02-02", "Ethical violation & falsified autism-MMR vaccine link"),
    ("10.1038/nature12968", "Stimulus-triggered fate conversion of somatic cells into pluripotency", "Nature", "2014-07-02", "Data fabrication and image manipulation"),
]
