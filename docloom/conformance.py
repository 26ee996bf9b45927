"""Cases of the public CommonMark and GFM specifications by section: (section, format, markdown, expected HTML).

The HTML is in this library's form: code blocks without a last line end, items of tight lists on one line, list types
and starts as attributes, quotes in inline code as they are.
"""

from __future__ import annotations

from collections import Counter

_CASES = {
    "Tabs": [("\tfoo\tbaz\t\tbim", "<pre><code>foo baz     bim</code></pre>"), ("  - foo\n\n\tbar", "<ul>\n<li><p>foo</p>\n<p>bar</p></li>\n</ul>"), ("#\tFoo", "<h1>Foo</h1>"), ("*\t*\t*\t", "<hr />")],
    "Backslash escapes": [
        ("\\!\\\"\\#\\$\\%\\&\\'\\(\\)", "<p>!\"#$%&amp;'()</p>"), ("\\A\\a\\ \\3\\φ\\«", "<p>\\A\\a\\ \\3\\φ\\«</p>"), ("\\\\*emphasis*", "<p>\\<em>emphasis</em></p>"),
        ("\\*not emphasized*", "<p>*not emphasized*</p>"), ("`` \\[\\` ``", "<p><code>\\[\\`</code></p>"), ("    \\[\\]", "<pre><code>\\[\\]</code></pre>"),
        ("<https://example.com?find=\\*>", '<p><a href="https://example.com?find=\\*">https://example.com?find=\\*</a></p>'), ("foo\\\nbar", "<p>foo<br />\nbar</p>"),
        ("[foo](/bar\\* \"ti\\*tle\")", '<p><a href="/bar*" title="ti*tle">foo</a></p>'),
    ],
    "Entities": [
        ("&nbsp; &amp; &copy; &AElig; &Dcaron;", "<p>\u00a0 &amp; © Æ Ď</p>"), ("&#35; &#1234; &#992; &#0;", "<p># Ӓ Ϡ \ufffd</p>"), ("&#X22; &#XD06; &#xcab;", "<p>\" ആ ಫ</p>"),
        ("&nbsp &x; &#; &#x;", "<p>&amp;nbsp &amp;x; &amp;#; &amp;#x;</p>"), ("&copy", "<p>&amp;copy</p>"), ("`f&ouml;&ouml;`", "<p><code>f&amp;ouml;&amp;ouml;</code></p>"), ("&#42;foo&#42;\n*foo*", "<p>*foo*\n<em>foo</em></p>"),
    ],
    "Precedence": [("- `one\n- two`", "<ul>\n<li>`one</li>\n<li>two`</li>\n</ul>")],
    "Thematic breaks": [
        ("***\n---\n___", "<hr />\n<hr />\n<hr />"), ("+++", "<p>+++</p>"), ("--\n**\n__", "<p>--\n**\n__</p>"), (" ***\n  ***\n   ***", "<hr />\n<hr />\n<hr />"), ("    ***", "<pre><code>***</code></pre>"),
        ("Foo\n    ***", "<p>Foo\n***</p>"), (" - - -", "<hr />"), ("_ _ _ _ a", "<p>_ _ _ _ a</p>"), ("a------", "<p>a------</p>"), (" *-*", "<p><em>-</em></p>"), ("- foo\n***\n- bar", "<ul>\n<li>foo</li>\n</ul>\n<hr />\n<ul>\n<li>bar</li>\n</ul>"),
        ("Foo\n***\nbar", "<p>Foo</p>\n<hr />\n<p>bar</p>"), ("Foo\n---\nbar", "<h2>Foo</h2>\n<p>bar</p>"), ("* Foo\n* * *\n* Bar", "<ul>\n<li>Foo</li>\n</ul>\n<hr />\n<ul>\n<li>Bar</li>\n</ul>"), ("- Foo\n- * * *", "<ul>\n<li>Foo</li>\n<li><hr /></li>\n</ul>"),
    ],
    "ATX headings": [
        ("# foo\n## foo\n### foo\n###### foo", "<h1>foo</h1>\n<h2>foo</h2>\n<h3>foo</h3>\n<h6>foo</h6>"), ("####### foo", "<p>####### foo</p>"), ("#5 bolt\n\n#hashtag", "<p>#5 bolt</p>\n<p>#hashtag</p>"), ("\\## foo", "<p>## foo</p>"),
        ("# foo *bar* \\*baz\\*", "<h1>foo <em>bar</em> *baz*</h1>"), ("#                  foo                     ", "<h1>foo</h1>"), ("    # foo", "<pre><code># foo</code></pre>"), ("foo\n    # bar", "<p>foo\n# bar</p>"),
        ("## foo ##\n  ###   bar    ###", "<h2>foo</h2>\n<h3>bar</h3>"), ("### foo ### b", "<h3>foo ### b</h3>"), ("# foo#", "<h1>foo#</h1>"), ("### foo \\###\n# foo \\#", "<h3>foo ###</h3>\n<h1>foo #</h1>"), ("## \n#\n### ###", "<h2></h2>\n<h1></h1>\n<h3></h3>"),
    ],
    "Setext headings": [
        ("Foo *bar*\n=========\n\nFoo *bar*\n---------", "<h1>Foo <em>bar</em></h1>\n<h2>Foo <em>bar</em></h2>"), ("Foo *bar\nbaz*\n====", "<h1>Foo <em>bar\nbaz</em></h1>"), ("Foo\n   ----      ", "<h2>Foo</h2>"), ("Foo\n    ---", "<p>Foo\n---</p>"),
        ("Foo\n= =\n\nFoo\n--- -", "<p>Foo\n= =</p>\n<p>Foo</p>\n<hr />"), ("> Foo\n---", "<blockquote>\n<p>Foo</p>\n</blockquote>\n<hr />"), ("- Foo\n---", "<ul>\n<li>Foo</li>\n</ul>\n<hr />"), ("Foo\nBar\n---", "<h2>Foo\nBar</h2>"),
        ("\n====", "<p>====</p>"), ("---\n---", "<hr />\n<hr />"), ("\\> foo\n------", "<h2>&gt; foo</h2>"),
    ],
    "Indented code blocks": [
        ("    a simple\n      indented code block", "<pre><code>a simple\n  indented code block</code></pre>"), ("  - foo\n\n    bar", "<ul>\n<li><p>foo</p>\n<p>bar</p></li>\n</ul>"), ("1.  foo\n\n    - bar", '<ol type="1">\n<li><p>foo</p>\n<ul>\n<li>bar</li>\n</ul></li>\n</ol>'),
        ("    <a/>\n    *hi*\n\n    - one", "<pre><code>&lt;a/&gt;\n*hi*\n\n- one</code></pre>"), ("    chunk1\n\n    chunk2\n  \n \n \n    chunk3", "<pre><code>chunk1\n\nchunk2\n\n\n\nchunk3</code></pre>"), ("Foo\n    bar", "<p>Foo\nbar</p>"), ("    foo\nbar", "<pre><code>foo</code></pre>\n<p>bar</p>"),
    ],
    "Fenced code blocks": [
        ("```\n<\n >\n```", "<pre><code>&lt;\n &gt;</code></pre>"), ("~~~\n<\n >\n~~~", "<pre><code>&lt;\n &gt;</code></pre>"), ("``\nfoo\n``", "<p><code>foo</code></p>"), ("```\naaa\n~~~\n```", "<pre><code>aaa\n~~~</code></pre>"), ("````\naaa\n```\n``````", "<pre><code>aaa\n```</code></pre>"),
        ("> ```\n> aaa\n\nbbb", "<blockquote>\n<pre><code>aaa</code></pre>\n</blockquote>\n<p>bbb</p>"), (" ```\n aaa\naaa\n```", "<pre><code>aaa\naaa</code></pre>"), ("    ```\n    aaa\n    ```", "<pre><code>```\naaa\n```</code></pre>"), ("``` ```\naaa", "<p><code> </code>\naaa</p>"),
        ("foo\n```\nbar\n```\nbaz", "<p>foo</p>\n<pre><code>bar</code></pre>\n<p>baz</p>"), ("```ruby\ndef foo(x)\n  return 3\nend\n```", '<pre class="ruby"><code>def foo(x)\n  return 3\nend</code></pre>'), ("``` aa ```\nfoo", "<p><code>aa</code>\nfoo</p>"),
    ],
    "HTML blocks": [
        ("<table><tr><td>\n<pre>\n**Hello**,\n\n_world_.\n</pre>\n</td></tr></table>", "<table><tr><td>\n<pre>\n**Hello**,\n<p><em>world</em>.\n</pre></p>\n</td></tr></table>"), ("<div id=\"foo\"\n  class=\"bar\">\n</div>", "<div id=\"foo\"\n  class=\"bar\">\n</div>"),
        ("<div>\n*foo*\n\n*bar*", "<div>\n*foo*\n<p><em>bar</em></p>"), ("<del>\n*foo*\n</del>", "<del>\n*foo*\n</del>"), ("<del>*foo*</del>", "<p><del><em>foo</em></del></p>"), ("<!-- Foo\n\nbar\n   baz -->\nokay", "<!-- Foo\n\nbar\n   baz -->\n<p>okay</p>"),
        ("Foo\n<div>\nbar\n</div>", "<p>Foo</p>\n<div>\nbar\n</div>"), ("Foo\n<a href=\"bar\">\nbaz", "<p>Foo\n<a href=\"bar\">\nbaz</p>"),
    ],
    "Link reference definitions": [
        ("[foo]: /url \"title\"\n\n[foo]", '<p><a href="/url" title="title">foo</a></p>'), ("   [foo]: \n      /url  \n           'the title'  \n\n[foo]", '<p><a href="/url" title="the title">foo</a></p>'), ("[Foo*bar\\]]:my_(url) 'title (with parens)'\n\n[Foo*bar\\]]", '<p><a href="my_(url)" title="title (with parens)">Foo*bar]</a></p>'),
        ("[foo]:\n/url\n\n[foo]", '<p><a href="/url">foo</a></p>'), ("[foo]:\n\n[foo]", "<p>[foo]:</p>\n<p>[foo]</p>"), ("[foo]: <>\n\n[foo]", '<p><a href="">foo</a></p>'), ("[foo]\n\n[foo]: first\n[foo]: second", '<p><a href="first">foo</a></p>'), ("[FOO]: /url\n\n[Foo]", '<p><a href="/url">Foo</a></p>'),
        ("[foo]: /url \"title\" ok", "<p>[foo]: /url \"title\" ok</p>"), ("    [foo]: /url \"title\"\n\n[foo]", "<pre><code>[foo]: /url &quot;title&quot;</code></pre>\n<p>[foo]</p>"), ("Foo\n[bar]: /baz\n\n[bar]", "<p>Foo\n[bar]: /baz</p>\n<p>[bar]</p>"), ("[foo]: /foo-url \"foo\"\n[bar]: /bar-url\n  \"bar\"\n\n[foo],\n[bar]", '<p><a href="/foo-url" title="foo">foo</a>,\n<a href="/bar-url" title="bar">bar</a></p>'),
        ("[foo]\n\n> [foo]: /url", '<p><a href="/url">foo</a></p>\n<blockquote>\n\n</blockquote>'),
    ],
    "Paragraphs": [("aaa\n\nbbb", "<p>aaa</p>\n<p>bbb</p>"), ("  aaa\n bbb", "<p>aaa\nbbb</p>"), ("aaa\n             bbb\n                                       ccc", "<p>aaa\nbbb\nccc</p>"), ("    aaa\nbbb", "<pre><code>aaa</code></pre>\n<p>bbb</p>"), ("aaa     \nbbb     ", "<p>aaa<br />\nbbb</p>"), ("  \n\naaa\n  \n\n# aaa\n\n  ", "<p>aaa</p>\n<h1>aaa</h1>")],
    "Block quotes": [
        ("> # Foo\n> bar\n> baz", "<blockquote>\n<h1>Foo</h1>\n<p>bar\nbaz</p>\n</blockquote>"), ("># Foo\n>bar\n> baz", "<blockquote>\n<h1>Foo</h1>\n<p>bar\nbaz</p>\n</blockquote>"), ("> bar\nbaz\n> foo", "<blockquote>\n<p>bar\nbaz\nfoo</p>\n</blockquote>"), ("> foo\n---", "<blockquote>\n<p>foo</p>\n</blockquote>\n<hr />"),
        ("> - foo\n- bar", "<blockquote>\n<ul>\n<li>foo</li>\n</ul>\n</blockquote>\n<ul>\n<li>bar</li>\n</ul>"), (">     foo\n    bar", "<blockquote>\n<pre><code>foo</code></pre>\n</blockquote>\n<pre><code>bar</code></pre>"), (">", "<blockquote>\n\n</blockquote>"), (">\n> foo\n>  ", "<blockquote>\n<p>foo</p>\n</blockquote>"),
        ("> foo\n\n> bar", "<blockquote>\n<p>foo</p>\n</blockquote>\n<blockquote>\n<p>bar</p>\n</blockquote>"), ("foo\n> bar", "<p>foo</p>\n<blockquote>\n<p>bar</p>\n</blockquote>"), ("> > > foo\nbar", "<blockquote>\n<blockquote>\n<blockquote>\n<p>foo\nbar</p>\n</blockquote>\n</blockquote>\n</blockquote>"), (">     code\n\n>    not code", "<blockquote>\n<pre><code>code</code></pre>\n</blockquote>\n<blockquote>\n<p>not code</p>\n</blockquote>"),
    ],
    "List items": [
        ("1.  A paragraph\n    with two lines.\n\n        indented code\n\n    > A block quote.", '<ol type="1">\n<li><p>A paragraph\nwith two lines.</p>\n<pre><code>indented code</code></pre>\n<blockquote>\n<p>A block quote.</p>\n</blockquote></li>\n</ol>'), ("- one\n\n two", "<ul>\n<li>one</li>\n</ul>\n<p>two</p>"), ("- one\n\n  two", "<ul>\n<li><p>one</p>\n<p>two</p></li>\n</ul>"),
        ("-one\n\n2.two", "<p>-one</p>\n<p>2.two</p>"), ("- foo\n\n\n  bar", "<ul>\n<li><p>foo</p>\n<p>bar</p></li>\n</ul>"), ("123456789. ok", '<ol start="123456789" type="1">\n<li>ok</li>\n</ol>'), ("1234567890. not ok", "<p>1234567890. not ok</p>"), ("0. ok", '<ol start="0" type="1">\n<li>ok</li>\n</ol>'), ("-1. not ok", "<p>-1. not ok</p>"),
        ("- foo\n-\n- bar", "<ul>\n<li>foo</li>\n<li></li>\n<li>bar</li>\n</ul>"), ("-\n  foo", "<ul>\n<li>foo</li>\n</ul>"), ("foo\n*\n\nfoo\n1.", "<p>foo\n*</p>\n<p>foo\n1.</p>"), ("- foo\n  - bar\n    - baz", "<ul>\n<li>foo\n<ul>\n<li>bar\n<ul>\n<li>baz</li>\n</ul></li>\n</ul></li>\n</ul>"), ("10) foo\n    - bar", '<ol start="10" type="1">\n<li>foo\n<ul>\n<li>bar</li>\n</ul></li>\n</ol>'),
        ("- - foo", "<ul>\n<li><ul>\n<li>foo</li>\n</ul></li>\n</ul>"), ("- # Foo\n- Bar\n  ---\n  baz", "<ul>\n<li><h1>Foo</h1></li>\n<li><h2>Bar</h2>\nbaz</li>\n</ul>"),
    ],
    "Lists": [
        ("- foo\n- bar\n+ baz", "<ul>\n<li>foo</li>\n<li>bar</li>\n</ul>\n<ul>\n<li>baz</li>\n</ul>"), ("1. foo\n2. bar\n3) baz", '<ol type="1">\n<li>foo</li>\n<li>bar</li>\n</ol>\n<ol start="3" type="1">\n<li>baz</li>\n</ol>'), ("Foo\n- bar\n- baz", "<p>Foo</p>\n<ul>\n<li>bar</li>\n<li>baz</li>\n</ul>"), ("The number is\n14.  The", "<p>The number is\n14. The</p>"),
        ("- foo\n\n- bar\n\n\n- baz", "<ul>\n<li><p>foo</p></li>\n<li><p>bar</p></li>\n<li><p>baz</p></li>\n</ul>"), ("- foo\n- bar\n\n<!-- -->\n\n- baz", "<ul>\n<li>foo</li>\n<li>bar</li>\n</ul>\n<!-- -->\n<ul>\n<li>baz</li>\n</ul>"), ("- a\n - b\n  - c\n   - d", "<ul>\n<li>a</li>\n<li>b</li>\n<li>c</li>\n<li>d</li>\n</ul>"), ("- a\n - b\n  - c\n   - d\n    - e", "<ul>\n<li>a</li>\n<li>b</li>\n<li>c</li>\n<li>d\n- e</li>\n</ul>"),
        ("- a\n- b\n\n- c", "<ul>\n<li><p>a</p></li>\n<li><p>b</p></li>\n<li><p>c</p></li>\n</ul>"), ("- a\n- ```\n  b\n\n\n  ```\n- c", "<ul>\n<li>a</li>\n<li><pre><code>b\n\n</code></pre></li>\n<li>c</li>\n</ul>"), ("- a\n  - b\n\n    c\n- d", "<ul>\n<li>a\n<ul>\n<li><p>b</p>\n<p>c</p></li>\n</ul></li>\n<li>d</li>\n</ul>"), ("* a\n  > b\n  >\n* c", "<ul>\n<li>a\n<blockquote>\n<p>b</p>\n</blockquote></li>\n<li>c</li>\n</ul>"), ("- a", "<ul>\n<li>a</li>\n</ul>"),
    ],
    "Code spans": [
        ("`foo`", "<p><code>foo</code></p>"), ("`` foo ` bar ``", "<p><code>foo ` bar</code></p>"), ("` `` `", "<p><code>``</code></p>"), ("`  ``  `", "<p><code> `` </code></p>"), ("` a`", "<p><code> a</code></p>"), ("``\nfoo\nbar  \nbaz\n``", "<p><code>foo bar   baz</code></p>"), ("`foo\\`bar`", "<p><code>foo\\</code>bar`</p>"), ("*foo`*`", "<p>*foo<code>*</code></p>"),
        ("[not a `link](/foo`)", "<p>[not a <code>link](/foo</code>)</p>"), ("`<a href=\"`\">`", "<p><code>&lt;a href=\"</code>\"&gt;`</p>"), ("```foo``", "<p>```foo``</p>"), ("`foo", "<p>`foo</p>"), ("`foo``bar``", "<p>`foo<code>bar</code></p>"),
    ],
    "Emphasis": [
        ("*foo bar*", "<p><em>foo bar</em></p>"), ("a * foo bar*", "<p>a * foo bar*</p>"), ("a*\"foo\"*", "<p>a*\"foo\"*</p>"), ("foo*bar*", "<p>foo<em>bar</em></p>"), ("5*6*78", "<p>5<em>6</em>78</p>"), ("_foo bar_", "<p><em>foo bar</em></p>"), ("foo_bar_", "<p>foo_bar_</p>"), ("foo-_(bar)_", "<p>foo-<em>(bar)</em></p>"), ("_foo*", "<p>_foo*</p>"), ("*(*foo", "<p>*(*foo</p>"),
        ("*(*foo*)*", "<p><em>(<em>foo</em>)</em></p>"), ("**foo bar**", "<p><strong>foo bar</strong></p>"), ("** foo bar**", "<p>** foo bar**</p>"), ("foo**bar**", "<p>foo<strong>bar</strong></p>"), ("__foo, __bar__, baz__", "<p><strong>foo, <strong>bar</strong>, baz</strong></p>"), ("*foo [bar](/url)*", '<p><em>foo <a href="/url">bar</a></em></p>'), ("_foo __bar__ baz_", "<p><em>foo <strong>bar</strong> baz</em></p>"),
        ("*foo**bar**baz*", "<p><em>foo<strong>bar</strong>baz</em></p>"), ("*foo**bar*", "<p><em>foo**bar</em></p>"), ("***foo** bar*", "<p><em><strong>foo</strong> bar</em></p>"), ("foo***bar***baz", "<p>foo<em><strong>bar</strong></em>baz</p>"), ("**foo*bar*baz**", "<p><strong>foo<em>bar</em>baz</strong></p>"), ("foo ***", "<p>foo ***</p>"), ("foo *\\**", "<p>foo <em>*</em></p>"), ("**foo*", "<p>*<em>foo</em></p>"), ("*foo**", "<p><em>foo</em>*</p>"), ("***foo**", "<p>*<strong>foo</strong></p>"), ("****foo*", "<p>***<em>foo</em></p>"),
        ("******foo******", "<p><strong><strong><strong>foo</strong></strong></strong></p>"), ("_____foo_____", "<p><em><strong><strong>foo</strong></strong></em></p>"), ("*foo _bar* baz_", "<p><em>foo _bar</em> baz_</p>"), ("**foo **bar baz**", "<p>**foo <strong>bar baz</strong></p>"), ("*[bar*](/url)", '<p>*<a href="/url">bar*</a></p>'), ("*a `*`*", "<p><em>a <code>*</code></em></p>"),
    ],
    "Links": [
        ("[link](/uri \"title\")", '<p><a href="/uri" title="title">link</a></p>'), ("[](./target.md)", '<p><a href="./target.md"></a></p>'), ("[link]()", '<p><a href="">link</a></p>'), ("[link](/my uri)", "<p>[link](/my uri)</p>"), ("[link](</my uri>)", '<p><a href="/my uri">link</a></p>'), ("[link](foo\nbar)", "<p>[link](foo\nbar)</p>"), ("[a](<b)c>)", '<p><a href="b)c">a</a></p>'), ("[link](\\(foo\\))", '<p><a href="(foo)">link</a></p>'), ("[link](foo(and(bar)))", '<p><a href="foo(and(bar))">link</a></p>'),
        ("[link](foo(and(bar))", "<p>[link](foo(and(bar))</p>"), ("[link](#fragment)", '<p><a href="#fragment">link</a></p>'), ("[link](/url 'title \"and\" title')", '<p><a href="/url" title="title &quot;and&quot; title">link</a></p>'), ("[link] (/uri)", "<p>[link] (/uri)</p>"), ("[link [foo [bar]]](/uri)", '<p><a href="/uri">link [foo [bar]]</a></p>'), ("[link] bar](/uri)", "<p>[link] bar](/uri)</p>"), ("[link \\[bar](/uri)", '<p><a href="/uri">link [bar</a></p>'),
        ("[link *foo **bar** `#`*](/uri)", '<p><a href="/uri">link <em>foo <strong>bar</strong> <code>#</code></em></a></p>'), ("[foo [bar](/uri)](/uri)", '<p>[foo <a href="/uri">bar</a>](/uri)</p>'), ("[foo][bar]\n\n[bar]: /url \"title\"", '<p><a href="/url" title="title">foo</a></p>'), ("[foo][BaR]\n\n[bar]: /url", '<p><a href="/url">foo</a></p>'), ("[foo] [bar]\n\n[bar]: /url", '<p>[foo] <a href="/url">bar</a></p>'), ("[foo][]\n\n[foo]: /url", '<p><a href="/url">foo</a></p>'), ("[*foo* bar][]\n\n[*foo* bar]: /url", '<p><a href="/url"><em>foo</em> bar</a></p>'),
        ("[foo]\n\n[foo]: /url", '<p><a href="/url">foo</a></p>'), ("[[bar [foo]\n\n[foo]: /url", '<p>[[bar <a href="/url">foo</a></p>'), ("\\[foo]\n\n[foo]: /url", "<p>[foo]</p>"), ("[foo][bar][baz]\n\n[baz]: /url", '<p>[foo]<a href="/url">bar</a></p>'),
    ],
    "Images": [("![foo](/url \"title\")", '<p><img src="/url" title="title" alt="foo" /></p>'), ("![foo *bar*][]\n\n[foo *bar*]: t.jpg", '<p><img src="t.jpg" alt="foo bar" /></p>'), ("![foo](<url>)", '<p><img src="url" alt="foo" /></p>'), ("![](/url)", '<p><img src="/url" alt="" /></p>'), ("!\\[foo]\n\n[foo]: /url", "<p>![foo]</p>"), ("\\![foo]\n\n[foo]: /url", '<p>!<a href="/url">foo</a></p>')],
    "Autolinks": [("<http://foo.bar.baz>", '<p><a href="http://foo.bar.baz">http://foo.bar.baz</a></p>'), ("<MAILTO:FOO@BAR.BAZ>", '<p><a href="MAILTO:FOO@BAR.BAZ">MAILTO:FOO@BAR.BAZ</a></p>'), ("<https://foo.bar/baz bim>", "<p>&lt;https://foo.bar/baz bim&gt;</p>"), ("<foo@bar.example.com>", '<p><a href="mailto:foo@bar.example.com">foo@bar.example.com</a></p>'), ("<>", "<p>&lt;&gt;</p>"), ("< https://foo.bar >", "<p>&lt; https://foo.bar &gt;</p>"), ("<m:abc>", "<p>&lt;m:abc&gt;</p>"), ("<foo.bar.baz>", "<p>&lt;foo.bar.baz&gt;</p>")],
    "Raw HTML": [("<a><bab><c2c>", "<p><a><bab><c2c></p>"), ("<a/><b2/>", "<p><a/><b2/></p>"), ("Foo <responsive-image src=\"foo.jpg\" />", "<p>Foo <responsive-image src=\"foo.jpg\" /></p>"), ("<33> <__>", "<p>&lt;33&gt; &lt;__&gt;</p>"), ("< a><\nfoo>", "<p>&lt; a&gt;&lt;\nfoo&gt;</p>"), ("foo <!-- this is a --\ncomment -->", "<p>foo <!-- this is a --\ncomment --></p>"), ("foo <?php echo $a; ?>", "<p>foo <?php echo $a; ?></p>"), ("foo <a href=\"\\*\">", "<p>foo <a href=\"\\*\"></p>")],
    "Hard line breaks": [("foo  \nbaz", "<p>foo<br />\nbaz</p>"), ("foo       \n     bar", "<p>foo<br />\nbar</p>"), ("*foo  \nbar*", "<p><em>foo<br />\nbar</em></p>"), ("`code  \nspan`", "<p><code>code   span</code></p>"), ("foo\\", "<p>foo\\</p>"), ("foo  ", "<p>foo</p>"), ("### foo\\", "<h3>foo\\</h3>")],
    "Soft line breaks": [("foo\nbaz", "<p>foo\nbaz</p>"), ("foo \n baz", "<p>foo\nbaz</p>")],
}
_GFM = {
    "GFM tables": [
        ("| foo | bar |\n| --- | --- |\n| baz | bim |", '<table>\n<thead>\n<tr>\n<th>foo</th>\n<th>bar</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>baz</td>\n<td>bim</td>\n</tr>\n</tbody>\n</table>'),
        ("| abc | def |\n| --- |\n| bar |", "<p>| abc | def |\n| --- |\n| bar |</p>"),
    ],
    "GFM strikethrough": [("~~Hi~~ Hello, ~there~ world!", "<p><del>Hi</del> Hello, <del>there</del> world!</p>"), ("This ~~has a\n\nnew paragraph~~.", "<p>This ~~has a</p>\n<p>new paragraph~~.</p>"), ("This will ~~~not~~~ strike.", "<p>This will ~~~not~~~ strike.</p>")],
    "GFM autolinks": [
        ("www.commonmark.org", '<p><a href="http://www.commonmark.org">www.commonmark.org</a></p>'), ("Visit www.commonmark.org/a.b.", '<p>Visit <a href="http://www.commonmark.org/a.b">www.commonmark.org/a.b</a>.</p>'), ("www.google.com/search?q=Markup+(business)", '<p><a href="http://www.google.com/search?q=Markup+(business)">www.google.com/search?q=Markup+(business)</a></p>'),
        ("(www.google.com/search?q=Markup+(business))", '<p>(<a href="http://www.google.com/search?q=Markup+(business)">www.google.com/search?q=Markup+(business)</a>)</p>'), ("http://commonmark.org", '<p><a href="http://commonmark.org">http://commonmark.org</a></p>'), ("foo@bar.baz", '<p><a href="mailto:foo@bar.baz">foo@bar.baz</a></p>'),
    ],
}
CASES = [(section, fmt, text, want + "\n") for fmt, cases in (("commonmark", _CASES), ("gfm", _GFM)) for section, found in cases.items() for text, want in found]


def totals() -> dict[str, int]:
    """How many cases each section has."""
    return dict(Counter(c[0] for c in CASES))
