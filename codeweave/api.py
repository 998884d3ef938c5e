"""One method per analytic tool of the reference service, same names and
argument names, each returning DataFrames instead of rendered text.

    ca = CodeAnalytics(CodeGraph.from_parquet(spark, "/data/code_graph"))
    ca.analyze_function_complexity(min_complexity=10).show()

Where a tool answered for one named entity, the method takes the name
(and optional module) and answers for every entity of that name; pass a
DataFrame of keys to the operators in ``codeweave.operators`` to ask for
many at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import constants as C
from .operators import (calls, classes, functions, imports, location, modules, patterns,
                        similarity, sqlapi, types)
from .sources.tables import CodeGraph


def _fn_key(function_name: str, module_name: str | None):
    return [(function_name, module_name)] if module_name else [function_name]


class CodeAnalytics:
    def __init__(self, graph: CodeGraph):
        self.g = graph
        self._corpus = None

    @property
    def corpus(self) -> DataFrame:
        if self._corpus is None:
            self._corpus = similarity.function_corpus(self.g)
        return self._corpus

    # -- modules ---------------------------------------------------------
    def list_modules(self, limit=C.LIMIT_MODULES):
        return modules.list_modules(self.g, limit)

    def get_module_details(self, module_name):
        return modules.module_details(self.g, [module_name])

    def get_functions_by_module(self, module_name, limit=C.LIMIT_LISTING,
                                include_signatures=True):
        return modules.functions_by_module(self.g, [module_name], limit, include_signatures)

    def search_modules(self, pattern, limit=C.LIMIT_SEARCH):
        return modules.search_modules(self.g, pattern, limit)

    def get_module_dependencies(self, module_name, include_imports=True, include_dependents=False):
        return modules.module_dependencies(self.g, [module_name], include_imports,
                                           include_dependents)

    def get_code_statistics(self, include_details=False):
        return modules.code_statistics(self.g, include_details)

    # -- functions -------------------------------------------------------
    def get_function_details(self, function_name, module_name=None):
        return functions.function_details(self.g, _fn_key(function_name, module_name))

    def search_functions(self, pattern, limit=C.LIMIT_SEARCH):
        return functions.search_functions(self.g, pattern, limit)

    def get_most_called_functions(self, limit=C.LIMIT_MOST_CALLED):
        return functions.most_called_functions(self.g, limit)

    def get_function_call_graph(self, function_name, module_name=None, depth=2,
                                include_callers=True, include_callees=True):
        return calls.call_neighbours(self.g, _fn_key(function_name, module_name), depth,
                                     include_callers, include_callees)

    def get_function_callers(self, function_name, module_name=None, limit=C.LIMIT_CALLERS,
                             resolve="name"):
        return functions.function_callers(self.g, _fn_key(function_name, module_name), limit,
                                          resolve)

    def get_function_callees(self, function_name, module_name=None, limit=C.LIMIT_CALLERS):
        return functions.function_callees(self.g, _fn_key(function_name, module_name), limit)

    def find_cross_module_calls(self, source_module=None, target_module=None,
                                limit=C.LIMIT_CROSS_MODULE_CALLS):
        return functions.cross_module_calls(self.g, source_module, target_module, limit)

    def analyze_function_complexity(self, module_name=None, min_complexity=C.MIN_COMPLEXITY,
                                    limit=C.LIMIT_COMPLEXITY):
        return functions.function_complexity(self.g, module_name, min_complexity, limit)

    def enhanced_function_call_graph(self, function_name, module_name=None, max_depth=3,
                                     graph_format="tree", include_signatures=False,
                                     filter_modules=None):
        return calls.enhanced_call_graph(self.g, _fn_key(function_name, module_name), max_depth,
                                         graph_format, include_signatures, filter_modules)

    def get_function_context(self, function_name, module_name=None,
                             include_local_definitions=True, include_external_references=True,
                             include_body=False):
        key = _fn_key(function_name, module_name)
        return (location.function_context(self.g, key, include_local_definitions,
                                          include_external_references, include_body),
                location.function_context_items(self.g, key))

    # -- types -----------------------------------------------------------
    def list_types(self, module_name=None, pattern=None, type_category=None,
                   limit=C.LIMIT_LISTING):
        return types.list_types(self.g, module_name, pattern, type_category, limit)

    def get_type_details(self, type_name, module_name=None, include_constructors=True,
                         include_fields=True):
        key = [(type_name, module_name)] if module_name else [type_name]
        return types.type_details(self.g, key, include_constructors, include_fields)

    def search_types(self, pattern, module_pattern=None, type_category=None,
                     limit=C.LIMIT_SEARCH):
        return types.search_types(self.g, pattern, module_pattern, type_category, limit)

    def get_type_dependencies(self, type_name, module_name=None, include_dependents=False,
                              depth=2):
        key = [(type_name, module_name)] if module_name else [type_name]
        return types.type_dependencies(self.g, key, include_dependents, depth)

    def analyze_type_usage(self, type_name=None, module_name=None, usage_threshold=1, limit=50):
        if type_name:
            return types.type_usage(self.g, [type_name], module_name, usage_threshold)
        return types.types_by_category(self.g, module_name, C.SAMPLE_TYPES_PER_CATEGORY)

    def get_type_functions(self, type_name, limit=C.LIMIT_TYPE_FUNCTIONS):
        return types.type_functions(self.g, [type_name], limit)

    def build_type_dependency_graph(self, root_type=None, module_pattern=None,
                                    include_external=False, max_depth=3):
        return types.type_graph(self.g, root_type, module_pattern, include_external, max_depth)

    def get_nested_types(self, type_names, gateway_name, exclude_pattern=None,
                         include_raw_definitions=True):
        return types.nested_types(self.g, type_names, gateway_name, exclude_pattern,
                                  include_raw_definitions)

    def analyze_type_relationships(self, type_name, source_module, analysis_depth=2,
                                   include_dependents=True, module_filter=None):
        return types.type_relationships(self.g, type_name, source_module, analysis_depth,
                                        include_dependents, module_filter)

    # -- classes ---------------------------------------------------------
    def list_classes(self, module_name=None, pattern=None, limit=C.LIMIT_LISTING):
        return classes.list_classes(self.g, module_name, pattern, limit)

    def get_class_details(self, class_name, module_name=None, include_instances=True):
        key = [(class_name, module_name)] if module_name else [class_name]
        return classes.class_details(self.g, key, include_instances)

    def search_classes(self, pattern, module_pattern=None, limit=C.LIMIT_SEARCH):
        return classes.search_classes(self.g, pattern, module_pattern, limit)

    # -- imports ---------------------------------------------------------
    def analyze_imports(self, module_name=None, import_pattern=None, include_qualified=True,
                        limit=C.LIMIT_LISTING):
        return imports.analyze_imports(self.g, module_name, import_pattern, include_qualified,
                                       limit)

    def get_import_graph(self, root_module=None, depth=3, include_external=False, limit=50):
        return imports.import_graph_overview(self.g, root_module, depth, include_external,
                                             None if root_module else C.LIMIT_POPULAR_IMPORTS)

    def find_unused_imports(self, module_name=None, package_pattern=None, limit=C.LIMIT_LISTING):
        return imports.suspicious_imports(self.g, module_name, package_pattern, limit)

    def get_import_details(self, module_name, include_source_info=True):
        return imports.import_details(self.g, [module_name], include_source_info)

    def generate_function_imports(self, element_name=None, source_module=None,
                                  element_type="any", import_style="haskell"):
        return location.generate_imports(self.g, [source_module] if source_module else None,
                                         element_type, import_style, element_name)

    # -- similarity and patterns -------------------------------------------
    def find_similar_functions(self, function_name=None, module_name=None,
                               similarity_threshold=C.SIMILARITY_THRESHOLD, limit=C.LIMIT_SIMILAR):
        keys = None
        if function_name:
            f = self.g.function.filter(F.col("name") == function_name)
            if module_name:
                f = f.filter(F.col("module_name") == module_name)
            keys = f.select("id")
        return similarity.similar_functions(self.corpus, keys, similarity_threshold, limit)

    def find_code_patterns(self, pattern_code, min_matches=C.MIN_PATTERN_MATCHES,
                           module_pattern=None, limit=C.LIMIT_CODE_PATTERNS):
        return similarity.code_patterns(similarity.body_corpus(self.g), pattern_code, min_matches,
                                        module_pattern, limit)

    def group_similar_functions(self, similarity_threshold=C.SIMILARITY_THRESHOLD,
                                module_pattern=None, min_group_size=C.MIN_GROUP_SIZE,
                                limit=C.LIMIT_GROUPS):
        return similarity.similarity_groups(self.corpus, similarity_threshold, module_pattern,
                                            min_group_size, limit)

    def pattern_match_code(self, pattern_type, pattern_config, limit=50):
        return patterns.pattern_match(self.g, pattern_type, pattern_config, limit)

    def analyze_cross_module_dependencies(self, analysis_type="dependencies", module_pattern=None,
                                          include_metrics=True,
                                          threshold=C.DEPENDENCY_THRESHOLD,
                                          limit=C.LIMIT_CROSS_DEPENDENCIES):
        if analysis_type == "dependencies":
            return patterns.cross_module_dependencies(self.g, module_pattern, threshold, limit)
        if analysis_type == "coupling":
            return (patterns.coupling_totals(self.g),
                    patterns.module_coupling(self.g, module_pattern, threshold, limit))
        if analysis_type == "complexity":
            return patterns.complexity_metrics(self.g, module_pattern, threshold, limit)
        raise ValueError("analysis_type must be dependencies, coupling or complexity")

    # -- locations -------------------------------------------------------
    def find_element_by_location(self, probes: DataFrame, base_directory="",
                                 element_types=("all",)):
        return location.elements_at(self.g, probes, base_directory, element_types)

    def get_location_context(self, probes: DataFrame, context_radius=5,
                             include_dependencies=True):
        ctx = location.location_context(self.g, probes, context_radius)
        if include_dependencies:
            return ctx, location.location_items(self.g, probes)
        return ctx

    # -- queries ---------------------------------------------------------
    def execute_query(self, query_type, name_pattern=None, module_id=None, limit=C.LIMIT_LISTING):
        return (sqlapi.basic_query(self.g, query_type, name_pattern, module_id, limit),
                sqlapi.basic_query_count(self.g, query_type, name_pattern, module_id))

    def execute_advanced_query(self, query: dict):
        return sqlapi.entity_query(self.g, query)

    def execute_custom_query(self, sql, parameters=None, limit=C.LIMIT_LISTING):
        return sqlapi.custom_sql(self.g, sql, parameters, limit)
