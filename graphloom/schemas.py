"""Declared schemas. Nothing is inferred: an input whose lists are all empty must still read as arrays of structs."""

from __future__ import annotations

#: A typed property graph as two long tables. ``project_id`` is part of every key, so equal names in two projects stay apart.
NODES = "project_id string, node_id bigint, label string, uid string, name string, file_path string, props map<string,string>"
EDGES = "project_id string, src_id bigint, dst_id bigint, rel string, props map<string,string>"
NODE_KEY = ("project_id", "node_id")
EDGE_KEY = ("project_id", "src_id", "dst_id", "rel")

#: Fields of each label beside its key, as they are written to ``props``.
NODE_FIELDS = {
    "Project": ("projectId", "name", "description", "file_path"),
    "File": ("filePath", "name", "modifiedAt"),
    "Function_Component": ("uid", "name", "filePath", "syntax", "usesHooks", "returnsJSX", "exportType", "isRoot"),
    "Class_Component": ("uid", "name", "filePath", "extendsClass", "exportType", "hasConstructor", "lifecycleMethods", "returnsJSX", "isRoot"),
    "Library_Hook": ("uid", "name", "source"),
    "Custom_Hook": ("uid", "name", "filePath", "exportType"),
    "Prop": ("uid", "name", "componentName", "filePath", "type", "isRequired"),
    "State_Variable": ("uid", "name", "setterName", "type", "defaultValue", "filePath", "componentName"),
    "Context": ("uid", "name", "filePath", "defaultValue", "exportType"),
    "EventHandler": ("uid", "name", "eventType", "filePath", "componentName", "isInline"),
    "Library": ("name", "version", "category"),
}
COMPONENTS = ("Function_Component", "Class_Component")
ANCHORS = (*COMPONENTS, "Custom_Hook")

#: Extraction records, one column for each list of a file's result.
HOOK = "struct<name:string,category:string,source:string>"
EXTRACTION = {
    "components": f"array<struct<name:string,syntax:string,usesHooks:boolean,hookDetails:array<{HOOK}>,returnsJSX:boolean,exportType:string>>",
    "customHooks": "array<struct<name:string,syntax:string,exportType:string,parameters:array<string>,returnShape:string>>",
    "classComponents": "array<struct<name:string,extendsClass:string,from:string,exportType:string,hasConstructor:boolean,lifecycleMethods:array<string>,returnsJSX:boolean>>",
    "props": "array<struct<name:string,componentName:string,type:string,isRequired:boolean>>",
    "eventHandlers": "array<struct<name:string,eventType:string,componentName:string,isInline:boolean>>",
    "stateVariables": "array<struct<name:string,setterName:string,type:string,defaultValue:string,componentName:string,declarationPattern:string>>",
    "classStateVariables": "array<struct<name:string,setterName:string,type:string,defaultValue:string,componentName:string,declarationStyle:string>>",
    "contexts": "array<struct<name:string,defaultValue:string,exportType:string>>",
    "componentUsages": "array<struct<parentComponent:string,childComponent:string,importSource:string,usage:string,propsPassed:array<struct<propName:string,valueExpression:string>>>>",
    "customHookUsages": "array<struct<hookName:string,libraryHooks:array<struct<name:string,source:string,count:int>>,customHooks:array<struct<name:string,source:string>>>>",
    "contextProviders": "array<struct<componentName:string,contextName:string,contextSource:string,valueExpression:string>>",
    "contextConsumers": "array<struct<consumerName:string,consumerType:string,contextName:string,contextSource:string,consumptionMethod:string>>",
    "routeDefinitions": "array<struct<routingComponent:string,targetComponent:string,importSource:string,path:string,isNested:boolean,isLazy:boolean,isProtected:boolean>>",
}
EXTRACTIONS = "project_id string, file_path string, " + ", ".join(f"{k} {v}" for k, v in EXTRACTION.items())

HARNESS_RESULT = (
    "task_id string, candidate_id string, condition string, model string, stage string, exit_code int, stdout string, stderr string,"
    " duration_ms double, timeout_used_ms bigint, stage_detail string, apply_mode string, apply_reason string"
)
USAGE = "struct<input_tokens:bigint,output_tokens:bigint>"
CALL_LOG = (
    "timestamp string, run_id string, task_id string, condition_id string, replicate int, model_id string, openrouter_provider string, call_purpose string,"
    f" usage {USAGE}, params map<string,string>, prompt array<struct<role:string,content:string>>, response string, latency_ms double, rate_limit map<string,string>,"
    " error struct<error_type:string,message:string>"
)
CACHE_USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"
EXTRACTION_LOG = (
    "timestamp string, run_id string, project string, stage string, call_purpose string, prompt_id string, file_path string, model_id string, cache_hit boolean, attempts int,"
    f" usage {CACHE_USAGE}, attempt_usage array<{CACHE_USAGE}>, latency_ms double, rate_limit map<string,string>, error struct<error_type:string,message:string>"
)
EDITS = "array<struct<path:string,op:string,search:string,content:string>>"
EDIT_SCRIPT = f"format string, edits {EDITS}, elided boolean, elision_marker string, malformed_blocks int"
ENDPOINT = "struct<label:string,name:string,owner:string,loc:string>"
ITEM = f"struct<kind:string,src:{ENDPOINT},rel:string,dst:{ENDPOINT},key:struct<k:string,v:string>>"
EMBEDDING_CACHE = "key string, kind string, label string, batch struct<id:string,size:int,prompt_tokens:bigint>, created string, embedding_b64 string"
CHECKPOINT = "file_path string, project_id string, stage string, llm_results string, updated_at timestamp"
TASK = (
    "task_id string, project_id string, git_commit string, task_type string, spec string, expected_anchors struct<anchor_names:array<string>,anchor_routes:array<string>>,"
    " reference_patch string, test_files array<string>, files_modified array<string>, files_created array<string>"
)
