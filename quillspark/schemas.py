"""DDL of sample kinds, annotations and their parts."""

BBOX = "array<double>"
ELEMENT = f"struct<id:int,parent_id:int,level:int,bbox:{BBOX},text:string,conf:double,angle:double,segmentation:array<array<double>>>"
ELEMENTS = f"struct<bbox_mode:string,normalized:boolean,items:array<{ELEMENT}>>"
CONTENT = f"struct<text:string,elements:{ELEMENTS}>"
IMAGE = "struct<file_path:string,content_bytes:binary,crop_box:array<int>>"
VISUAL = "struct<file_path:string,content_bytes:binary,crop_box:array<int>,page_id:int,dpi:int>"
TURN = "struct<type:string,role:string,text:string,custom_role:string,name:string,arguments:string,content:string>"
QA_PAIR = "struct<id:int,question_text:string,answer_text:string,start:int,end:int,alternative_answers:array<string>>"
OBJECT = f"struct<label_value:bigint,label_name:string,bbox:{BBOX},segmentation:array<array<double>>,iscrowd:boolean>"
DETECTION = f"struct<bbox_mode:string,normalized:boolean,objects:array<{OBJECT}>>"

#: At most one annotation per type: a nullable field each.
ANNOTATIONS = {
    "classification": "struct<label_value:bigint,label_name:string>",
    "entity_labeling": "struct<word_label_values:array<bigint>,word_label_names:array<string>>",
    "question_answering": f"array<{QA_PAIR}>",
    "multi_page_question_answering": "array<struct<id:int,question_text:string,answer_text:string,evidence_pages:array<int>,arithmetic_expression:string,evidence_sources:array<string>,answer_format:string>>",
    "object_detection": DETECTION,
    "layout_analysis": DETECTION,
    "transcription": "struct<text:string,level:int>",
    "sentiment": "struct<scores:map<string,double>,meta:map<string,string>>",
    "ocr": ELEMENTS,
}
ANNOTATIONS_DDL = "struct<" + ",".join(f"{k}:{v}" for k, v in ANNOTATIONS.items()) + ">"
HEADER = f"sample_id string, metadata map<string,string>, annotations {ANNOTATIONS_DDL}"
KINDS = {
    "data": HEADER,
    "text": f"{HEADER}, text string",
    "image": f"{HEADER}, image {IMAGE}",
    "page": f"{HEADER}, visual_type string, visual {VISUAL}, content {CONTENT}",
    "document": f"{HEADER}, pages array<struct<sample_id:string,visual_type:string,visual:{VISUAL},content:{CONTENT},annotations:{ANNOTATIONS_DDL}>>",
    "conversation": f"{HEADER}, turns array<{TURN}>",
}
LEVELS = {"page": 1, "block": 2, "paragraph": 3, "line": 4, "word": 5}
ROLES = ("system", "user", "assistant", "tool", "developer", "function", "other")
SPLITS = ("train", "test", "validation")
