"""Prompt templates and their rendering."""

from __future__ import annotations

import re
from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column, functions as F

from unitloom.functions.tokens import TokenCounter, count_tokens, fits_budget

# Prompt texts, fence and fallback must be exactly so for prompts to agree.
SYSTEM_PROMPT = """
<s> [INST] <<SYS>>
You are an expert Java programmer. Write a class with unit tests using {testing_framework} and {mocking_framework}, testing the method provided. Use reflection to access private methods and fields.
Think step by step! First describe what provided code does in one sentence. Second, list a maximum of three cases that need to be checked to test the provided method.
Last, write a Java class that contains a test case for each of the identified cases. Add comments within the code to explain each line.
Answer shortly and concisely. Wrap the Java code in "```" "```" tags.
<</SYS>>
"""
LEVEL_1 = """
Write a unit test for the following method:
Method: {method_name}
Class: {class_name}
Package: {package}
Imports: 
{imports}

Method code: 
```java
{method_code}
```

[\\INST]

[AI]:
"""
LEVEL_2 = """
Generate a unit test for the following method:
Method: {method_name}
Class: {class_name}
Package: {package}
Imports: 
{imports}

Method code: 
```java
{method_code}
```

This is the constructor of the class in which the method is defined:
```java
{class_header}
```

[\\INST]

[AI]:
"""
LEVEL_3 = """
Generate a unit test for the following method:
Method: {method_name}
Class: {class_name}
Package: {package}
Imports: 
{imports}

Method code: 
```java
{method_code}
```

This is the constructor of the class in which the method is defined:
```java
{class_header}
```

Here is some additional code that might be useful:

Related methods: 

{related_methods}

[\\INST]

[AI]:
"""
LEVEL_4 = """
Generate a unit test for the following method:
Method: {method_name}
Class: {class_name}
Package: {package}
Imports: 
{imports}

Method code: 
```java
{method_code}
```

This is the constructor of the class in which the method is defined:
```java
{class_header}
```

Here is some additional code that might be useful:

Related methods: 

{related_methods}

Related classes: 

{related_classes}

[\\INST]

[AI]:
"""
COMPILE_REPAIR = """
<s> [INST] <<SYS>>
You are an expert Java programmer who corrects compile errors in Java code.
Explain the error and how you can fix it. Then write the correct code. Do not just return the corrected line, but ALWAYS return the entire corrected class.
Add comments in the code, explaining each line and its purpose. ALWAYS wrap the Java code in ```java [code] ``` tags.
<</SYS>>
Please correct the following compile error:
{error_message}

It occurred when compiling the following method:
```java
{method_text}
```

[\\INST]

[AI]:
"""
EXECUTION_REPAIR = """
<s> [INST] <<SYS>>
You are an expert Java programmer who corrects execution errors in Java code. Explain the error and how you can fix it. Then write the correct code. Always provide the entire corrected class instead of just the corrected line.
Wrap the Java code in ```java [code] ``` tags.
<</SYS>>
Please correct the following execution error:
{error_message}

It occurred when executing the following class:
```java
{method_text}
```

[\\INST]

[AI]:
"""
FRAMEWORKS = {"testing_framework": "JUnit 5", "mocking_framework": "Mockito"}
NO_RELATIONS = "No relations found."
LANGUAGE = "java"
INPUT_BUDGET = 4096

#: Level templates, smallest first.
LEVELS = tuple(f"{SYSTEM_PROMPT}\n{body}" for body in (LEVEL_1, LEVEL_2, LEVEL_3, LEVEL_4))


def render_template(template: str, values: Mapping[str, Column | str]) -> Column:
    """Fill a template's placeholders.

    The template is split once on the driver and concatenated, so a value that looks
    like a placeholder is never filled again.  A missing value reads ``None``.
    """
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            value = values[name]
            pieces.append(F.lit(value) if isinstance(value, str) else F.coalesce(value, F.lit("None")))
    return F.concat(*pieces) if pieces else F.lit("")


def placeholders(template: str) -> set[str]:
    return {name for _, name, _, _ in Formatter().parse(template) if name is not None}


def token_parts(template: str, values: Mapping[str, Column | str]) -> tuple[int, list[str]] | None:
    """Tokens of a template's own text, and the columns whose tokens add to them.

    None unless white space surrounds every column's placeholder: only then is the token
    count of a rendered template the sum of its parts.
    """
    text, columns, joined = " ", [], False
    for literal, name, _, _ in Formatter().parse(template):
        if joined and literal and not literal[0].isspace():
            return None
        text, joined = text + literal, joined and not literal
        if name is None:
            continue
        if isinstance(values[name], str):
            if joined:
                return None
            text += values[name]
        elif joined or not text[-1].isspace():
            return None
        else:
            columns.append(name)
            joined = True
    return len(re.findall(r"\S+", text)), columns


def render_levels(values: Mapping[str, Column | str], levels: tuple[str, ...] = LEVELS) -> list[Column]:
    """One prompt per level, smallest first."""
    return [render_template(template, {**FRAMEWORKS, **values}) for template in levels]


def code_block(text: Column, title: Column | None = None, language: str = LANGUAGE) -> Column:
    """A fenced block, with a title line where ``title`` is given (F8)."""
    block = [F.lit(f"```{language}\n"), text, F.lit("\n```\n")]
    return F.concat(*([title] if title is not None else []), *block)


def member_title(name: Column, owner: Column) -> Column:
    """Title line of a related method (F8)."""
    return F.concat(F.lit("Method: "), name, F.lit(" of the class "), owner, F.lit(":\n"))


def repair_prompt(
    text: Column,
    error: Column,
    budget: int = INPUT_BUDGET,
    template: str = COMPILE_REPAIR,
    counter: TokenCounter | None = None,
) -> Column:
    """Prompt that asks for a repair, '' where it does not fit the budget."""
    prompt = render_template(template, {"error_message": error, "method_text": text})
    return F.when(fits_budget(count_tokens(prompt, counter), budget), prompt).otherwise("")
