"""Word lists, patterns and label vocabularies as plain data. All are fixed values."""

EXPLICIT = ["mixed method", "mixed methods", "mixed methodology", "mixed methodologies", "mixed research", "mixed methods research", "multi method", "multi methods", "multimethod", "multimethods", "multimethodology", "multimethodologies", "mmr"]
QUAL = ["qualitative", "interview", "interviews", "focus group", "focus groups", "case study", "case studies", "observation", "observations", "classroom observation", "classroom observations", "field note", "field notes", "open ended", "thematic analysis", "content analysis", "discourse analysis", "coding", "grounded theory", "narrative analysis"]
QUAL_STARTS = ["ethnograph", "phenomenolog"]
QUANT = ["quantitative", "survey", "surveys", "questionnaire", "questionnaires", "statistical", "statistics", "regression", "logistic regression", "linear model", "anova", "ancova", "t test", "chi square", "experiment", "experiments", "experimental", "randomized", "randomised", "quasi experimental", "pre post", "assessment", "scale", "factor analysis", "structural equation", "sem", "bayesian", "data mining", "learning analytics", "modeling", "modelling"]
QUANT_STARTS = ["experiment"]
IMPLICIT = ["qualitative and quantitative", "quantitative and qualitative", "both qualitative and quantitative", "qualitative quantitative", "quantitative qualitative", "interviews and surveys", "survey and interview", "surveys and interviews", "focus groups and surveys", "surveys and focus groups", "case study and statistical", "case studies and statistical", "thematic analysis and regression"]
DESIGN = ["convergent parallel", "convergent design", "explanatory sequential", "sequential explanatory", "exploratory sequential", "sequential exploratory", "embedded design", "transformative design", "multiphase design", "triangulation design"]
INTEGRATION = ["meta inference", "metainference", "joint display", "building from qualitative to quantitative", "building from quantitative to qualitative", "integrate qualitative quantitative", "integrate quantitative qualitative", "integrating qualitative quantitative", "integrating quantitative qualitative", "merge qualitative quantitative", "merge quantitative qualitative", "merged qualitative quantitative", "merged quantitative qualitative", "triangulate qualitative quantitative", "triangulate quantitative qualitative", "triangulating qualitative quantitative", "triangulating quantitative qualitative", "combined qualitative quantitative", "combined quantitative qualitative", "connect qualitative quantitative", "connect quantitative qualitative"]
INTEGRATION_STARTS = ["integrat", "merge", "merg", "triangulat", "combin", "connect"]
METHOD_HEAVY = ["method", "methods", "methodology", "methodological", "data collection", "data analysis", "evaluation", "assessment", "measure", "measures", "sample", "participants", "instrument", "instruments", "protocol", "survey", "surveys", "interview", "interviews", "observation", "observations", "statistical", "regression", "case study", "case studies"]
METHOD_HEAVY_STARTS = ["methodolog", "evaluat", "assess", "measur"]

# the proximity rule
DIRECT_STRONG = ["joint display", "joint displays", "meta inference", "meta inferences", "metainference", "metainferences", "building from qualitative to quantitative", "building from quantitative to qualitative"]
STRONG_VERBS = ["integrat", "merge", "merg", "triangulat"]
WEAK_VERBS = ["combin", "connect"]
NEAR_QUAL = ["qualitative", "interview", "focus", "thematic", "coding", "coded", "ethnograph", "phenomenolog", "narrative"]
NEAR_QUANT = ["quantitative", "survey", "questionnaire", "statistical", "regression", "anova", "ancova", "randomized", "randomised", "experimental", "experiment", "bayesian"]
NEAR_CONTEXT = ["data", "dataset", "datasets", "finding", "findings", "result", "results", "analysis", "analyses", "evidence", "strand", "strands", "phase", "phases", "inference", "inferences", "theme", "themes", "response", "responses"]
NEAR_MMR = ["mixed method", "mixed methods", "mixed methodology", "mixed methodologies", "multi method", "multi methods", "multimethod", "multimethods", "mmr"]
NEAR_GENERIC = ["curriculum", "curricula", "course", "courses", "classroom", "module", "modules", "laboratory", "laboratories", "lab", "labs", "program", "programs", "degree", "degrees", "discipline", "disciplines", "disciplinary", "interdisciplinary", "computing", "computation", "computational", "mathematics", "statistics", "biology", "physics", "chemistry", "engineering", "ethics", "sustainability", "concept", "concepts", "content", "instruction", "instructional", "teaching", "learning", "workforce", "school", "schools", "community", "communities"]
WINDOW = 14

# patterns of the rule classifier, on raw text without regard to case
RULES = {
    "explicit": r"\b(mixed[-\s]?methods?|mixed[-\s]?methodolog(?:y|ies)|mixed\s+research|multi[-\s]?methods?|multimethods?|mmr)\b",
    "qual": r"\b(qualitative|interviews?|focus\s+groups?|case\s+stud(?:y|ies)|ethnograph\w*|observations?|field\s+notes?|open[-\s]?ended|thematic\s+analysis|coding|grounded\s+theory|narrative\s+analysis)\b",
    "quant": r"\b(quantitative|surveys?|questionnaires?|statistical|statistics|regression|anova|ancova|t[-\s]?test|chi[-\s]?square|experiment\w*|randomi[sz]ed|quasi[-\s]?experimental|pre[-\s]?post|assessment|scale|factor\s+analysis|structural\s+equation|sem|bayesian|data\s+mining|learning\s+analytics|modeling|modelling)\b",
    "design": r"\b(convergent\s+parallel|convergent\s+design|explanatory\s+sequential|sequential\s+explanatory|exploratory\s+sequential|sequential\s+exploratory|embedded\s+design|transformative\s+design|multiphase\s+design|triangulation\s+design)\b",
    "integration": r"\b(joint\s+displays?|meta[-\s]?inferences?|integrat\w*.{0,100}(qualitative|quantitative|mixed[-\s]?methods?|findings|results|analysis)|triangulat\w*.{0,100}(qualitative|quantitative|findings|results)|merg\w*.{0,100}(qualitative|quantitative|findings|results))\b",
    "method": r"\b(methodolog\w*|methods?|data\s+collection|data\s+analysis|evaluation|assess\w*|measure\w*|sample|participants?|instruments?|protocol)\b",
}
CLASSES = ["explicit_mmr", "implicit_mmr", "qual_only", "quant_only", "multi_method_not_mmr", "unclear", "no_method_signal"]

VOCABULARY = {
    "label_mmr_class": CLASSES,
    "label_qual_signal": ["yes", "no", "unclear"],
    "label_quant_signal": ["yes", "no", "unclear"],
    "label_design_present": ["yes", "no", "unclear"],
    "label_design_type": ["convergent", "explanatory_sequential", "exploratory_sequential", "embedded", "transformative", "multiphase", "triangulation", "other", "none", "unclear", "mixed_methods_explicit", "mixed_methods_implicit", "program_evaluation", "case_study", "quantitative_general", "qualitative_general", "ethnographic_or_observational", "survey", "learning_analytics_or_computational", "longitudinal", "instrument_development_validation", "participatory_or_community_based", "experimental", "design_based_research", "quasi_experimental"],
    "label_integration_present": ["yes", "no", "unclear"],
    "label_integration_type": ["merging", "connecting", "embedding", "triangulation", "joint_display", "meta_inference", "other", "none", "unclear", "explicit_mixed_methods", "implicit_unspecified", "evaluation_integration", "explanatory_sequential_quant_to_qual", "exploratory_sequential_qual_to_quant", "instrument_development", "embedded", "design_iteration", "convergent_parallel"],
    "label_reporting_completeness": ["low", "medium", "high", "unclear", "none_no_report", "minimal", "partial", "adequate", "complete"],
}
REPORTING_ORDER = {"none_no_report": 0, "minimal": 1, "partial": 2, "adequate": 3, "complete": 4, "low": 0, "medium": 1, "high": 2}
MMR_POSITIVE = ["explicit_mmr", "implicit_mmr"]
METHOD_SIGNAL = ["explicit_mmr", "implicit_mmr", "qual_only", "quant_only", "multi_method_not_mmr"]

#: Weights of shared entities in the award projection.
ENTITY_WEIGHTS = {"person": 3.0, "institution": 1.0, "program": 1.0, "org": 0.5, "directorate": 0.25, "state": 0.25, "year": 0.1}
#: Predecessors that a row is linked to, by kind of shared entity, in the order in which they are credited.
PRIOR_LINKS = {"person": 10, "institution": 5, "program": 8, "org": 2, "directorate": 1}
#: Shares of the strata of an annotation sample.
STRATUM_WEIGHTS = {"design_integration_enriched": 0.12, "explicit_mmr": 0.18, "implicit_mmr": 0.18, "qual_only_hard_negative": 0.14, "quant_only_hard_negative": 0.14, "method_heavy_background": 0.12, "random_background": 0.12}
